"""The stage chain: retries, repeated and resumed batches, and the same results as the batch flow."""

import json

import pytest
from pyspark.sql import functions as F

from covenantry.operators.pages import normalize_pages, page_rows
from covenantry.plans import flow
from covenantry.streaming import stages as G

UPLOAD = ("document_id long, asset_id string, uploaded_by long, source_name string, mime_type string, raw_text string, error string")


def uploads(spark, texts, first=1):
    return spark.createDataFrame([(first + i, f"a{i % 2}", 7, f"d{i}.txt", "text/plain", t, None) for i, t in enumerate(texts)], UPLOAD)


def rows(spark, root, name):
    return sorted(map(str, spark.read.parquet(f"{root}/{name}").drop("batch", "attempt").collect()))


def stages_of(calls, flaky=(), lost=(), crash=()):
    """Two small stages that note when they are computed; some documents fail once, some always."""
    def first(step):
        calls.append(("first", step.attempt, sorted(r.document_id for r in step.due.collect())))
        bad = list(lost) + (list(flaky) if step.attempt == 1 else [])
        failed = step.due.filter(F.col("document_id").isin(bad)).withColumn("error", F.lit("no"))
        return {"one": step.due.withColumn("x", F.col("document_id") * 2)}, failed

    def second(step):
        calls.append(("second", step.attempt, sorted(r.document_id for r in step.due.collect())))
        if crash and crash.pop():
            raise RuntimeError("lost")
        return {"two": step.table("one")}, None

    return (G.Stage("first", first, fatal=True), G.Stage("second", second), G.Stage("last", lambda s: ({"all": s.due}, None), everyone=True))


def test_failed_documents_alone_are_tried_again(spark, tmp_path):
    calls, root = [], str(tmp_path)
    world = G.World(G.Asks(), spark.createDataFrame([], "user_id long, asset_id string"))
    G.run_stages(root, world, stages_of(calls, flaky=[2], lost=[3]))(uploads(spark, "abcd"), 0)
    assert calls == [("first", 1, [1, 2, 3, 4]), ("first", 2, [2, 3]), ("first", 3, [3]), ("second", 1, [1, 2, 4])]
    held = {(r.document_id, r.attempt) for r in spark.read.parquet(f"{root}/one").collect()}
    assert held == {(1, 1), (4, 1), (2, 2), (3, 3)}
    ledger = {(r.document_id, r.attempt, r.status) for r in spark.read.parquet(f"{root}/ledger").filter("stage = 'first'").collect()}
    assert ledger == {(1, 1, "ok"), (2, 1, "failed"), (3, 1, "failed"), (4, 1, "ok"), (2, 2, "ok"), (3, 2, "failed"), (3, 3, "failed")}
    assert len(rows(spark, root, "all")) == 4


def test_a_batch_goes_on_where_it_was_lost(spark, tmp_path):
    calls, root, crash = [], str(tmp_path), [True]
    world = G.World(G.Asks(), spark.createDataFrame([], "user_id long, asset_id string"))
    run = G.run_stages(root, world, stages_of(calls, crash=crash))
    with pytest.raises(RuntimeError):
        run(uploads(spark, "ab"), 0)
    # what an uncommitted attempt left behind is replaced
    spark.range(5).write.parquet(f"{root}/two/batch=0/attempt=1")
    run(uploads(spark, "ab"), 0)
    assert [c[0] for c in calls] == ["first", "second", "second"]
    before = {t: rows(spark, root, t) for t in ("uploads", "one", "two", "all", "ledger")}
    run(uploads(spark, "ab"), 0)
    assert len(calls) == 3 and before == {t: rows(spark, root, t) for t in before}
    # the next batch takes what is new only
    run(uploads(spark, "abc", first=10).withColumn("asset_id", F.when(F.col("raw_text") == "c", "a0").otherwise(F.col("asset_id"))), 1)
    assert calls[-2:] == [("first", 1, [12]), ("second", 1, [12])]


PAY = "Party A shall pay $500 to Party B within 10 days of delivery of the goods."
SHIP = "Party B must deliver the ordered goods to the warehouse of Party A by the first of July."
DEFECT = "The goods may be damaged in transit and the carrier accepts no liability for it."
LATE = "Party A shall inspect every delivery on the day of its arrival."


def asks(lists_of=json.dumps):
    stamp = F.lit("2024-01-01").cast("timestamp")

    def answer(of):
        @F.udf("string")
        def body(document_id):
            return of(document_id)

        def ask(about, attempt):
            return about.select("document_id").distinct().select(
                "document_id", F.lit(0).alias("call_no"), stamp.alias("created_at"), body("document_id").alias("raw"))
        return ask

    def obligations(d):
        if d == 3:
            return "not an answer"
        return lists_of([{"quote": PAY, "obligation_type": "payment", "modality": "shall"},
                         {"quote": PAY.replace("10", "12"), "obligation_type": "payment"},
                         {"quote": SHIP, "obligation_type": "submission", "due_date": "2024-07-01"}])

    def critic(about, attempt):
        sunk = F.to_json(F.struct(
            F.collect_list(F.struct(F.col("item_id").alias("id"), (~F.col("quote").contains("deliver the")).alias("valid"), F.lit(75).alias("confidence"))).alias("validations"),
            F.array(F.struct(F.lit(LATE).alias("quote"), F.lit("inspection").alias("obligation_type")),
                    F.struct(F.lit(PAY).alias("quote"), F.lit("payment").alias("obligation_type")),
                    F.struct(F.lit("no such words stand on any page at all").alias("quote"), F.lit("other").alias("obligation_type"))).alias("new_obligations")))
        return about.groupBy("document_id").agg(sunk.alias("raw")).select("document_id", F.lit(0).alias("call_no"), stamp.alias("created_at"), "raw")

    def rescore(about, attempt):
        low = F.to_json(F.collect_list(F.struct(
            F.col("item_id").alias("id"), F.lit("critical").alias("revised_severity"),
            F.when(F.col("quote").contains("damaged"), 10).otherwise(80).alias("quality_confidence"))))
        return about.groupBy("document_id").agg(low.alias("raw")).select("document_id", F.lit(0).alias("call_no"), stamp.alias("created_at"), "raw")

    return G.Asks(obligations=answer(obligations),
                  risks=answer(lambda d: lists_of({"risks": [{"quote": DEFECT, "risk_type": "quality", "severity": "high"}]})),
                  critic=critic, rescore=rescore)


def test_chain_and_batch_flow_agree(spark, tmp_path):
    root = str(tmp_path)
    text = f"{PAY}\n{SHIP}\n{DEFECT}\n{LATE}"
    docs = uploads(spark, [text, f"{LATE} {DEFECT}", text + "\nmore", None, "x" * 70])
    world = G.World(asks(), spark.createDataFrame([(8, "a0"), (9, "a1")], "user_id long, asset_id string"))
    run = G.run_stages(root, world)
    run(docs, 0)
    run(docs, 0)

    status = {r.document_id: r.parse_status for r in spark.read.parquet(f"{root}/documents").collect()}
    assert status == {1: "complete", 2: "complete", 3: "partially_processed", 4: "failed", 5: "complete"}
    got = spark.read.parquet(f"{root}/final_obligations")
    seen = {(r.document_id, r.obligation_text): (r.status, r.critic_valid, r.llm_severity) for r in got.collect()}
    assert len(seen) == got.count()
    assert seen[1, PAY][0] == "needs_review" and seen[1, SHIP][:2] == ("rejected", False)
    assert seen[1, LATE] == ("needs_review", True, "critical") and seen[3, LATE][0] == "needs_review"
    assert (3, SHIP) not in seen and not any("no such words" in t for _, t in seen)
    assert sum(d == 1 for d, _ in seen) == 3  # the near copy of PAY and the critic's PAY are no items
    risks = {r.document_id: r.status for r in spark.read.parquet(f"{root}/final_risks").collect()}
    assert risks == {d: "rejected" for d in (1, 2, 3, 5)}
    told = {(r.document_id, r.event_type, r.user_id) for r in spark.read.parquet(f"{root}/user_notifications").collect()}
    assert (4, "processing_complete", 9) in told and (4, "risk_detected", 9) not in told and (1, "risk_detected", 8) in told

    # the batch flow over the same documents
    read = docs.filter("raw_text is not null")
    pages = normalize_pages(page_rows(read.select("document_id", F.lit(1).alias("page_number"), "raw_text", "error")))
    typed = read.select("document_id", F.lit("unknown").alias("doc_type"))
    mine = read.select("document_id")
    found = flow.verify(flow.extract_obligations(world.asks.obligations(mine, 3)), flow.extract_risks(world.asks.risks(mine, 3)), pages)
    found = flow.criticize(found, world.asks.critic(flow.as_items(found.obligations, found.risks), 1), pages)
    found = flow.score(found, typed)
    found = flow.rescore(found, world.asks.rescore(flow.as_items(found.obligations, found.risks), 1))
    for name, key in (("obligations", "obligation_id"), ("risks", "risk_id")):
        columns = [key, "document_id", "status", "system_confidence", "critic_valid", "critic_confidence", "llm_severity", "llm_quality_confidence"]
        want = sorted(map(str, getattr(found, name).select(*columns).collect()))
        assert sorted(map(str, spark.read.parquet(f"{root}/final_{name}").select(*columns).collect())) == want
