"""The rule base: fixed values that decide results, passed to operators as parameters.

Everything here is small and fixed, so operators inline it as literals; no
dimension table has to be broadcast for it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Document domains in the order in which they are consulted.
DOMAINS: dict[str, dict] = {
    "construction": {
        "doc_types": ["contract", "rfi", "change_order", "invoice"],
        "heuristics": {
            "contract": ["agree", "party", "parties", "shall", "obligation"],
            "rfi": ["request for information", "clarification", "rfi"],
            "change_order": ["change order", "modification", "amendment"],
            "invoice": ["invoice", "amount", "total", "usd"],
        },
        "stage_keywords": {
            "obligation_extraction": [
                "shall", "must", "required", "within", "deadline", "deliver", "submit",
                "payment", "comply",
            ],
            "risk_extraction": [
                "penalty", "damages", "liquidated", "indemnif", "bond", "insurance", "risk",
                "breach", "liable", "delay", "default", "terminate", "non-compliance",
            ],
            "entity_extraction": [
                "llc", "inc", "company", "contractor", "owner", "party", "city", "county",
                "address",
            ],
        },
        "doc_type_aligned": {
            "invoice": ["payment"],
            "contract": ["compliance", "submission", "payment", "notification"],
            "rfi": ["submission", "notification"],
            "change_order": ["payment", "submission"],
        },
    },
    "real_estate": {
        "doc_types": [
            "lease", "inspection_report", "purchase_agreement", "title_commitment",
            "hoa_document", "disclosure_report",
        ],
        "heuristics": {
            "lease": ["tenant", "landlord", "rent", "lease", "lessee", "lessor", "tenancy"],
            "inspection_report": ["inspect", "examin", "assess", "finding"],
            "purchase_agreement": [
                "purchase price", "buyer", "seller", "closing", "contingency", "escrow",
            ],
            "title_commitment": [
                "title insurance", "commitment", "title defect", "encumbrance", "schedule b",
            ],
            "hoa_document": [
                "homeowner", "association", "assessment", "cc&r", "bylaw", "common area",
            ],
            "disclosure_report": [
                "disclosure", "lead", "mold", "environmental", "seller disclosure",
            ],
        },
        "stage_keywords": {
            "obligation_extraction": [
                "shall", "must", "required", "tenant", "landlord", "buyer", "seller", "closing",
                "assessment", "disclose",
            ],
            "risk_extraction": [
                "defect", "encumbrance", "lien", "default", "breach", "eviction", "easement",
                "hazard", "contamination",
            ],
            "entity_extraction": [
                "buyer", "seller", "tenant", "landlord", "association", "title company",
                "escrow",
            ],
        },
        "doc_type_aligned": {
            "lease": ["payment", "compliance", "notification"],
            "inspection_report": ["inspection", "compliance"],
            "purchase_agreement": ["payment", "submission", "compliance"],
            "title_commitment": ["compliance", "submission"],
            "hoa_document": ["payment", "compliance"],
            "disclosure_report": ["compliance", "notification"],
        },
    },
    "financial": {
        "doc_types": ["insurance_policy", "loan_agreement", "deed_of_trust"],
        "heuristics": {
            "insurance_policy": [
                "insured", "insurer", "premium", "coverage", "deductible", "policyholder",
                "claim",
            ],
            "loan_agreement": [
                "borrower", "lender", "promissory", "principal", "interest rate", "repayment",
                "maturity",
            ],
            "deed_of_trust": [
                "trustor", "trustee", "beneficiary", "deed of trust", "mortgage",
                "security instrument", "encumber",
            ],
        },
        "stage_keywords": {
            "obligation_extraction": [
                "shall", "must", "required", "premium", "repayment", "payment", "insured",
                "borrower", "lender", "covenants", "maintain", "disclose",
            ],
            "risk_extraction": [
                "default", "foreclosure", "acceleration", "claim denial", "exclusion",
                "subrogation", "lapse", "non-payment", "breach", "penalty", "liability",
            ],
            "entity_extraction": [
                "borrower", "lender", "insurer", "insured", "trustee", "beneficiary",
                "mortgagee",
            ],
        },
        "doc_type_aligned": {
            "insurance_policy": ["payment", "compliance", "notification"],
            "loan_agreement": ["payment", "compliance", "submission"],
            "deed_of_trust": ["payment", "compliance"],
        },
    },
    "general": {
        "doc_types": ["unknown"],
        "heuristics": {"unknown": []},
        "stage_keywords": {
            "obligation_extraction": ["shall", "must", "required", "within", "deadline"],
            "risk_extraction": ["penalty", "damages", "risk", "breach", "default"],
            "entity_extraction": ["company", "party", "address"],
        },
        "doc_type_aligned": {},
    },
}

# Obligation type synonyms, the same in every domain.
OBLIGATION_ALIASES = {
    "delivery": "submission",
    "maintenance": "inspection",
    "reporting": "compliance",
}

# Early document type guess, most specific first.
EARLY_TYPE_RULES: list[tuple[str, list[str]]] = [
    ("rfi", ["request for information", "rfi #", "rfi no"]),
    ("change_order", ["change order", "change no.", "change no #", "contract modification"]),
    ("invoice", ["invoice #", "invoice no", "bill to", "remit to", "payment due"]),
    ("inspection_report",
     ["inspection report", "site inspection", "deficiency", "field observation"]),
    ("lease", ["tenant", "landlord", "lessee", "lessor", "tenancy", "rental agreement"]),
    ("contract", ["agreement", "whereas", "in witness whereof", "hereinafter"]),
]

# Legacy risk taxonomy -> current one.
RISK_TYPE_REMAP = {
    "approval_overdue": "schedule",
    "payment_term_conflict": "contractual",
    "scope_change_indicator": "contractual",
    "schedule_dependency_blocker": "schedule",
    "missing_required_document": "compliance",
    "expired_certificate_or_insurance": "compliance",
    "inspection_failed_reinspection_required": "quality",
}

# Phrases that point to another document.
EXTERNAL_REFERENCE_PHRASES = (
    "per exhibit", "as defined in", "pursuant to", "referenced in", "attached hereto",
)

# Phrases that restate a statute, first hit names the reason.
STATUTORY_PATTERNS: list[tuple[str, str]] = [
    ("landlord_must", r"^\s*A\s+landlord\s+(must|may|shall)"),
    ("landlords_required", r"^\s*Landlord(s)?\s+(must|are\s+required)"),
    ("tenant_must", r"^\s*A\s+tenant\s+(must|may|shall)"),
    ("utility_required", r"^\s*Utility\s+companies\s+are\s+required"),
    ("under_code", r"Under\s+\[?(?:Section|Code|§)"),
    ("tenant_has_right", r"The\s+tenant\s+has\s+the\s+right\s+to"),
    ("illinois_law", r"Illinois\s+law\s+requires"),
    ("rlto_reference", r"(under\s+the\s+RLTO|RLTO\s+summary)"),
]


# Points and bounds of the scoring rules.
@dataclass(frozen=True)
class ScoreRules:
    """Points per signal; the two names at the end have no configured value."""

    quote_verified: int = 40
    strong_modality: int = 15
    due_date_resolved: int = 10
    responsible_party_linked: int = 10
    doc_type_aligned: int = 10
    verifier_pass: int = 15
    statute_reference: int = 10
    monetary_amount: int = 5
    explicit_deadline: int = 5
    cross_obligation_linked: int = 5
    external_reference: int = 5
    obligation_statute_reference: int = 5
    obligation_monetary_amount: int = 5
    weak_modality: int = -25
    ocr_source: int = -15
    contradiction: int = -30
    missing_deadline: int = -10
    sentence_verified: int = -10
    payment_no_amount: int = -10
    keep_from: int = 50


# Limits of the original service.  Those on pages, files and rows apply only where asked for.
@dataclass(frozen=True)
class Limits:
    max_pages: int = 500
    max_chars: int = 4000
    min_page_chars: int = 50
    bulk_files: int = 100
    export_rows: int = 50_000
    fuzzy_threshold: float = 0.85
    fuzzy_stop: float = 0.98
    critic_reject_from: int = 70
    critic_batch: int = 30
    rescore_reject_below: int = 30
    rescore_batch: int = 50
    judge_batch: int = 15
    chunks_per_group: int = 5
    mmr_lambda: float = 0.7
    bypass_ratio: float = 0.9
    token_threshold: int = 150_000
    prompt_overhead: int = 1500
    chars_per_token: int = 4


SCORE = ScoreRules()
LIMITS = Limits()


@dataclass(frozen=True)
class RuleBase:
    domains: dict = field(default_factory=lambda: DOMAINS)

    def domain_of(self) -> dict[str, str]:
        """doc_type -> first domain that lists it."""
        out: dict[str, str] = {}
        for name, body in self.domains.items():
            for doc_type in body.get("doc_types", []):
                out.setdefault(doc_type, name)
        return out

    def aligned_types(self) -> dict[str, list[str]]:
        """doc_type -> expected obligation types, from the first domain that lists it."""
        out: dict[str, list[str]] = {}
        for body in self.domains.values():
            for doc_type, expected in body.get("doc_type_aligned", {}).items():
                out.setdefault(doc_type, expected)
        return out

    def type_keywords(self) -> dict[str, list[str]]:
        """doc_type -> keywords of that type over all domains."""
        out: dict[str, list[str]] = {}
        for body in self.domains.values():
            for doc_type, words in body.get("heuristics", {}).items():
                out.setdefault(doc_type, []).extend(words)
        return out

    def stage_keywords(self, stage: str) -> dict[str, list[str]]:
        """domain -> keywords of the stage, with the general ones where a domain has none."""
        general = self.domains.get("general", {}).get("stage_keywords", {}).get(stage, [])
        return {
            name: body.get("stage_keywords", {}).get(stage, []) or general
            for name, body in self.domains.items()
        }


RULES = RuleBase()
