"""Fixed values of the ledger's formats: kinds, verdicts, severities, limits."""

from __future__ import annotations

# Message kind per tag. The tag of the anchor mirror is deployment-specific; a caller
# adds it with `{**KIND_OF_TAG, "<tag>": ANCHOR_KIND}`.
KIND_OF_TAG = {
    "trust.score": "trust.score",
    "LLO-K8s": "llo.k8s",
    "LLO-Docker": "llo.docker",
    "self-orchestrator": "self-orchestrator",
    "self-security": "self-security",
    "audit.report": "audit.report",
}
UNKNOWN_KIND = "unknown"
ANCHOR_KIND = "ledger.anchor"
SCORE_KIND = "trust.score"
ORCHESTRATOR_KIND = "self-orchestrator"
LLO_KINDS = ("llo.k8s", "llo.docker")
SECURITY_TAGS = ("self-orchestrator", "self-security")

# Verdicts.
PROVEN_VERDICTS = ("PRODUCER_SIGNED", "RELAY_ATTESTED")
UNSIGNED = "UNSIGNED_LEGACY"

# Severity per rule.
SEVERITY_OF_RULE = {
    "FORGED": "critical",
    "ANCHOR_MISMATCH": "critical",
    "MISSING_IN_DB": "critical",
    "DB_TAMPER": "critical",
    "CONTENT_MISMATCH": "critical",
    "NOT_FOUND": "critical",
    "REPLAY": "high",
    "UNAUTHORIZED_WRITER": "high",
    "REVOKED_KEY": "high",
    "CHAIN_FORK": "high",
    "SHADOW": "high",
    "ORPHANED": "high",
    "DRIFT": "medium",
    "ANOMALY": "medium",
    "CHAIN_GAP": "medium",
    "UNSIGNED": "medium",
    "STALE": "low",
    "UNKNOWN_IE": "low",
    "CLOCK_SKEW": "low",
    "MALFORMED": "low",
    "ANCHOR_UNVERIFIABLE": "low",
}
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
DISTRUST_RULES = ("SHADOW", "UNSIGNED")
ATTACK_RULES = ("FORGED", "REPLAY", "UNAUTHORIZED_WRITER", "REVOKED_KEY")
INTEGRITY_RULES = ("MISSING_IN_DB", "DB_TAMPER", "ANCHOR_MISMATCH", "CONTENT_MISMATCH", "NOT_FOUND", "ORPHANED")

# Patterns and limits of the formats.
IE_ID = r"^[^:\s]+:[0-9a-fA-F]{12}$"
IE_URN = "urn:ngsi-ld:InfrastructureElement:"
HEX32 = r"^0x[0-9a-f]{64}$"
NONCE = r"^[A-Za-z0-9_-]{21}[AQgw]$"
SIGNATURE = r"^[A-Za-z0-9_-]{85}[AQgw]$"
BASE58_DIGEST = r"^[1-9A-HJ-NP-Za-km-z]{32,64}$"
K8S_COMPONENT = r"(?i)^urn-ngsi-ld-service-([a-f0-9]+)-component-([a-z0-9-]+)$"
MAX_SAFE_INT = 2**53 - 1
MAX_MILESTONE = 0xFFFFFFFF
ENVELOPE_FIELDS = ("w", "tag", "iss", "kid", "seq", "iat", "nonce", "att", "body", "enc", "bix", "cmt",
                   "prev", "corr", "sig")
TEXT_MAX, ITEMS_MAX, TITLE_MAX, ID_MAX = 512, 64, 160, 120

# Rule thresholds.
DRIFT_EPSILON, DRIFT_GRACE_S, JUMP, STALE_S, SKEW_S = 0.01, 150, 0.3, 120, 300
CORROBORATION_S, SHADOW_GRACE_S, UNVERIFIABLE_GRACE_S, ORPHAN_S = 300, 30, 600, 60
WINDOW_MS, QUIET_MS, DROP, EPS = 600_000, 1_800_000, 0.2, 1e-9
CHECKPOINT_EVERY = 720
