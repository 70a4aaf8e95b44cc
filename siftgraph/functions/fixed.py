"""Patterns, word lists and constants that results depend on."""

# The keyword patterns of the gate, joined by "|" and matched without case.
KEYWORD_PATTERNS = [
    r"\bAI safety\b",
    r"\bAI alignment\b",
    r"\bvalue alignment\b",
    r"\bcorrigib",
    r"\bsafe reinforcement learning\b",
    r"\bsafety evaluation\b",
    r"\b(model|capabilit(y|ies)) evaluation\b.*\bsafety\b",
    r"\bred[- ]?teaming\b",
    r"\bjailbreak(s|ing)?\b",
    r"\bfrontier model(s)?\b.*\bsafety\b",
    r"\b(system prompt|model spec(ification)?)\b.*\bsafety\b",
    r"\bAI security\b",
    r"\b(model (security|exfiltration)|guardrail|risk mitigation)\b",
    r"\bAI (governance|governance framework|safety governance)\b",
    r"\b(governance|oversight|accountability|compliance|assurance)\b.*\b(AI|model|system)s?\b",
    r"\b(AI|model|system)s?\b.*\b(oversight|governance|accountability|assurance)\b",
    r"\b(risk (management|assessment)|impact assessment|RIA)\b.*\b(AI|model|system)s?\b",
    r"\b(policy|policies|regulation|regulatory|legislation|law|standard(s)?)\b.*\b(AI|model|system)s?\b",
    r"\b(AI|model|system)s?\b.*\b(policy|regulation|standards?|compliance)\b",
    r"\bassurance case(s)?\b|\bsafety case(s)?\b.*\b(AI|model|system)s?\b",
    r"\bmodel cards?\b|\bsystem cards?\b|\bAI incident(s)?\b|\bpostmortem(s)?\b",
    r"\bresponsible AI\b|\btrustworthy AI\b.*\b(governance|policy|standard|assurance)\b",
    r"\bred team(ing)?\b.*\b(governance|policy|safety)\b",
    r"\b(taxonomy|framework|benchmark|standardization)\b.*\b(safety|risk|governance)\b.*\b(AI|model|system)s?\b",
    r"\bEU AI Act\b|\bAI Act\b|\bNIST AI RMF\b|\bISO/IEC\s*42001\b|\bISO/IEC\s*23894\b",
]

# Fixed value: the looser pattern tried only on policy categories.
FALLBACK_PATTERN = (
    r"\b(AI|artificial intelligence|foundation model|frontier model|LLM|model|system)s?\b"
)

# Categories that count as policy.
POLICY_CATEGORIES = ["cs.CY", "cs.SI", "cs.CR"]
POLICY_PREFIXES = ["econ."]

# Category prefixes behind the domain tag.
GOVERNANCE_PREFIXES = ["econ."]
TECHNICAL_PREFIXES = ["cs.", "stat."]

# Words that make a label generic.
GENERIC_WORDS = [
    "artificial", "intelligence", "language", "agent", "agents", "model", "models", "system",
    "systems", "approach", "method", "task", "dataset", "framework", "paper", "study",
]

# Phrases used when no cluster yields a term.
DEFAULT_PHRASES = ["reinforcement learning", "governance", "robustness", "evaluation"]

# Record sources, first harvest day, vector model.
RECORD_SETS = ["cs", "stat", "econ"]
FIRST_DAY = "2005-09-16"
VECTOR_MODEL = "specter2"
ABSTRACT_URL = "https://arxiv.org/abs/"
PDF_URL = "https://arxiv.org/pdf/"

# Search weights and the degree bonus.
SEARCH_WEIGHTS = {"t": 3.0, "au": 2.0, "dm": 1.5, "sm": 1.0}
DEGREE_CAP = 50
DEGREE_BONUS = 0.02

NORM_EPS = 1e-12
