"""An upload's way through all stages, as a stream (L1).

Each micro-batch runs the fourteen stages in order, every one over all documents of the batch at
once.  Who came through is written to ``ledger/batch=b/stage=s/attempt=a``, what the stage gives
to ``table/batch=b/attempt=a``, and last one row to ``commits``, which makes the attempt count: a batch that is repeated after a failure takes committed attempts as they are, replaces what
an uncommitted one left, and so computes and stores every stage once.

A stage names the documents it failed for.  Those alone are tried again, twice at most.  Documents
whose reading fails for good leave the chain and are only reported at its end; where an extraction
fails for good, its failed run stays on record and the document goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from covenantry.functions.text import sha256_text
from covenantry.operators import pages as P
from covenantry.operators.notices import emit_notifications
from covenantry.operators.rollups import final_status, sample_pages
from covenantry.plans import flow
from covenantry.session import cut_lineage
from covenantry.sources.answers import entity_mentions, load_answers
from covenantry.sources.files import UPLOAD_KEY, ingest_new
from covenantry.streaming.uploads import stored

ATTEMPTS = 3
COMMIT = "stage string, attempt int, documents long, failed long"

# Rows asked about and the number of the attempt -> what came back.
Ask = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Asks:
    """The external models; None leaves a stage's rows as they are.

    Answers to ``mentions``, ``obligations``, ``risks``, ``critic`` and ``rescore`` are document_id,
    call_no, created_at, raw; ``mentions`` adds page_number.
    """

    ocr: Ask | None = None          # pages -> document_id, page_number, ocr_text, ocr_error
    classify: Ask | None = None     # sampled pages -> document_id, proposed_type, confidence
    sections: Ask | None = None     # chunks -> document_id, section, label, answer_no
    mentions: Ask | None = None     # chunks
    obligations: Ask | None = None  # chunks
    risks: Ask | None = None        # chunks
    critic: Ask | None = None       # items
    rescore: Ask | None = None      # items


@dataclass(frozen=True)
class World:
    """What the stages look up beside the batch."""

    asks: Asks
    assignments: DataFrame
    entities: DataFrame | None = None
    email_enabled: bool = False


@dataclass(frozen=True)
class Step:
    """The documents that are due, the tables that earlier stages of this batch wrote for them, the attempt."""

    store: Store
    batch: int
    due: DataFrame
    attempt: int
    world: World

    def table(self, name: str) -> DataFrame:
        rows = self.store.read(f"{name}/batch={self.batch}").drop("attempt")
        return rows.join(self.due, "document_id", "left_semi")


# Tables to write, and optionally the documents that failed: document_id, error.
Outcome = tuple[dict[str, DataFrame], DataFrame | None]


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[Step], Outcome]
    fatal: bool = False     # who fails for good leaves the chain
    everyone: bool = False  # also for those who left


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def read(self, path: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{path}").parquet(f"{self.root}/{path}")

    def write(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{path}")

    def commits(self, batch: int) -> dict[tuple[str, int], int]:
        """Failed documents of every committed attempt of a batch; only this batch's folder is listed."""
        try:
            rows = self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{self.root}/commits/batch={batch}")
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {(r.stage, r.attempt): r.failed for r in rows.collect()}

    def commit(self, batch: int, stage: str, attempt: int, documents: int, failed: int) -> int:
        row = self.spark.createDataFrame([(stage, attempt, documents, failed)], COMMIT)
        self.write(row.coalesce(1), f"commits/batch={batch}/stage={stage}/attempt={attempt}")
        return failed


# --- stages ------------------------------------------------------------------------------------

def parse(step: Step) -> Outcome:
    """Pages of the uploads; an upload without text cannot be read."""
    docs = step.table("uploads")
    pages = P.page_rows(docs.filter("raw_text is not null").select(
        "document_id", F.lit(1).alias("page_number"), "raw_text", "error"))
    failed = docs.filter("raw_text is null").select("document_id", F.lit("unreadable upload").alias("error"))
    return {"parsed_pages": pages}, failed


def ocr(step: Step) -> Outcome:
    pages = step.table("parsed_pages")
    if step.world.asks.ocr is None:
        return {"read_pages": pages}, None
    docs = step.table("uploads").withColumn("parse_status", F.lit("ocr"))
    return {"read_pages": P.apply_ocr(pages, docs, step.world.asks.ocr(pages.filter("is_scanned"), step.attempt)).join(
        pages.select("document_id", "page_number", "has_tables", "normalized_text", "text_sha256"), ["document_id", "page_number"])}, None


def normalize(step: Step) -> Outcome:
    return {"document_pages": P.normalize_pages(step.table("read_pages"))}, None


def chunk(step: Step) -> Outcome:
    return {"chunks": P.chunk_pages(step.table("document_pages"))}, None


def classify(step: Step) -> Outcome:
    docs = step.table("uploads").drop("raw_text", "error").withColumns({
        "doc_type": F.lit("unknown"), "doc_type_confidence": F.lit(None).cast("double"), "domain": F.lit(None).cast("string")})
    pages = step.table("document_pages")
    docs = P.early_types(docs, pages)
    if step.world.asks.classify is not None:
        docs = P.gate_types(docs, pages, step.world.asks.classify(sample_pages(pages, 3), step.attempt))
    return {"typed_documents": docs}, None


def sections(step: Step) -> Outcome:
    chunks = step.table("chunks")
    if step.world.asks.sections is None:
        labelled = chunks.withColumn("section_label", F.lit(None).cast("string"))
    else:
        labelled = P.label_sections(chunks, step.world.asks.sections(chunks, step.attempt))
    return {"labelled_chunks": P.section_filter(labelled)}, None


def mentions(step: Step) -> Outcome:
    if step.world.asks.mentions is None:
        return {}, None
    answers = step.world.asks.mentions(step.table("labelled_chunks"), step.attempt)
    return {"mentions": entity_mentions(load_answers(answers), "document_id", "call_no", "created_at", "page_number")}, None


def extract(step: Step) -> Outcome:
    """Candidates without their copies; a document of whose answers none can be read has failed."""
    chunks, asks = step.table("labelled_chunks"), step.world.asks
    none = step.due.select("document_id", F.lit(0).alias("call_no"), F.lit(None).cast("timestamp").alias("created_at"),
                           F.lit(None).cast("string").alias("raw")).limit(0)
    # an answer is asked for once, however many tables come from it
    asked = {name: none if ask is None else cut_lineage(ask(chunks, step.attempt))
             for name, ask in (("obligation_extraction", asks.obligations), ("risk_extraction", asks.risks))}
    runs = flow.answer_runs(asked["obligation_extraction"], "obligation_extraction").unionByName(
        flow.answer_runs(asked["risk_extraction"], "risk_extraction"))
    failed = runs.filter("status = 'failed'").groupBy("document_id").agg(F.min("error").alias("error"))
    return {"extracted_obligations": flow.extract_obligations(asked["obligation_extraction"], step.world.entities),
            "extracted_risks": flow.extract_risks(asked["risk_extraction"]), "extraction_runs": runs}, failed


# The tables of items that each stage revises; the others stay as the stage before left them.
REVISED = {
    "verified": tuple(f.name for f in fields(flow.Found)),
    "judged": ("obligations", "obligation_evidence", "risks", "risk_evidence"),
    "scored": ("obligations", "risks"),
    "final": ("obligations", "risks"),
}


def _found(step: Step, stage: str) -> flow.Found:
    """Items as a stage left them."""
    so_far = list(REVISED)[:list(REVISED).index(stage) + 1]
    last = {f.name: [s for s in so_far if f.name in REVISED[s]][-1] for f in fields(flow.Found)}
    return flow.Found(**{name: step.table(f"{s}_{name}") for name, s in last.items()})


def _tables(found: flow.Found, stage: str) -> dict[str, DataFrame]:
    return {f"{stage}_{name}": getattr(found, name) for name in REVISED[stage]}


def verify(step: Step) -> Outcome:
    found = flow.verify(step.table("extracted_obligations"), step.table("extracted_risks"), step.table("document_pages"))
    return _tables(found, "verified"), None


def criticize(step: Step) -> Outcome:
    found, ask = _found(step, "verified"), step.world.asks.critic
    if ask is not None:
        answers = ask(flow.as_items(found.obligations, found.risks), step.attempt)
        found = flow.criticize(found, answers, step.table("document_pages"), step.world.entities)
    return _tables(found, "judged"), None


def score(step: Step) -> Outcome:
    return _tables(flow.score(_found(step, "judged"), step.table("typed_documents")), "scored"), None


def rescore(step: Step) -> Outcome:
    found, ask = _found(step, "scored"), step.world.asks.rescore
    if ask is not None:
        found = flow.rescore(found, ask(flow.as_items(found.obligations, found.risks), step.attempt))
    return _tables(found, "final"), None


def persist(step: Step) -> Outcome:
    """Final status of every document, also of those that could not be read."""
    docs = step.table("uploads").drop("raw_text", "error")
    kinds = step.table("typed_documents").select("document_id", "doc_type", "doc_type_confidence", "domain")
    read = step.table("parsed_pages").select("document_id").distinct().withColumn("_read", F.lit(True))
    docs = docs.join(kinds, "document_id", "left").join(read, "document_id", "left").withColumns({
        "doc_type": F.coalesce("doc_type", F.lit("unknown")),
        "parse_status": F.when(F.col("_read"), "rescoring").otherwise("failed")}).drop("_read")
    done = final_status(docs, step.table("document_pages"), step.table("extraction_runs"))
    return {"documents": done.withColumn("parse_status", F.col("final_status")).drop("final_status")}, None


def notify(step: Step) -> Outcome:
    events, rows = emit_notifications(step.table("documents"), step.world.assignments, step.table("final_risks"),
                                      email_enabled=step.world.email_enabled)
    return {"notification_events": events, "user_notifications": rows}, None


STAGES = (
    Stage("parse", parse, fatal=True), Stage("ocr", ocr), Stage("normalize", normalize), Stage("chunk", chunk),
    Stage("classify", classify), Stage("section_classify", sections), Stage("extract_entities", mentions),
    Stage("extract_classify", extract), Stage("verify", verify), Stage("critic", criticize), Stage("score", score),
    Stage("rescore", rescore), Stage("persist", persist, everyone=True), Stage("notify", notify, everyone=True),
)


# --- the chain -----------------------------------------------------------------------------------

def _attempt(store: Store, stage: Stage, step: Step) -> int:
    """Write who comes through, then what the stage gives for them; the number of those who do not.

    What it gives for a document that is tried again is left out, so a table holds one attempt of each.
    """
    tables, failed = stage.run(step)
    if failed is None:
        ledger = step.due.withColumn("error", F.lit(None).cast("string"))
    else:
        ledger = step.due.join(failed, "document_id", "left")
    path = f"ledger/batch={step.batch}/stage={stage.name}/attempt={step.attempt}"
    store.write(ledger.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed")), path)
    counts = store.read(path).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed")).first()
    again = counts.failed and step.attempt < ATTEMPTS

    def keep(name: str) -> None:
        df = tables[name]
        if again:
            df = df.join(_failed(store, step.batch, stage.name, step.attempt), "document_id", "left_anti")
        store.write(df, f"{name}/batch={step.batch}/attempt={step.attempt}")

    # the tables of a stage are jobs that do not wait for each other
    with ThreadPoolExecutor(max(len(tables), 1)) as pool:
        list(pool.map(inheritable_thread_target(store.spark)(keep), tables))
    return store.commit(step.batch, stage.name, step.attempt, counts.n, counts.failed)


def _failed(store: Store, batch: int, stage: str, attempt: int) -> DataFrame:
    return store.read(f"ledger/batch={batch}/stage={stage}/attempt={attempt}").filter("status = 'failed'").select("document_id")


def run_stages(root: str, world: World, stages: tuple[Stage, ...] = STAGES) -> Callable[[DataFrame, int], None]:
    """Body of a micro-batch: accept what is new, then all stages."""
    def run(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, root)
        commits = store.commits(batch_id)
        if ("ingest", 1) not in commits:
            loads = batch.withColumn("sha256", sha256_text(F.coalesce("raw_text", F.lit(""))))
            known = stored(batch.sparkSession, root, "uploads", loads.select(*UPLOAD_KEY), batch_id)
            store.write(ingest_new(loads, known, "document_id"), f"uploads/batch={batch_id}/attempt=1")
            store.commit(batch_id, "ingest", 1, store.read(f"uploads/batch={batch_id}").count(), 0)
        everyone = store.read(f"uploads/batch={batch_id}").select("document_id")
        alive = everyone
        for stage in stages:
            due = everyone if stage.everyone else alive
            for attempt in range(1, ATTEMPTS + 1):
                failed = commits.get((stage.name, attempt))
                if failed is None:
                    failed = _attempt(store, stage, Step(store, batch_id, due, attempt, world))
                if not failed:
                    break
                due = _failed(store, batch_id, stage.name, attempt)
            if failed and stage.fatal:
                alive = alive.join(due, "document_id", "left_anti")

    return run


def process_documents(
    uploads: DataFrame, root: str, checkpoint: str, world: World, *, available_now: bool = False,
) -> StreamingQuery:
    """``uploads``: a stream of document_id, asset_id, uploaded_by, source_name, mime_type, raw_text, error.

    Results: ``documents``, ``final_obligations``, ``final_risks``, ``judged_obligation_evidence``,
    ``judged_risk_evidence``, ``verified_contradictions``, ``notification_events`` and
    ``user_notifications``; ``ledger`` tells how every document fared at every stage and attempt.
    """
    writer = uploads.writeStream.foreachBatch(run_stages(root, world)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
