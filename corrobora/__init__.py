"""Trust-aware fusion of conflicting claims, as Spark DataFrame operators."""

from corrobora.operators.components import connected_components
from corrobora.operators.fuse import (
    abstain,
    collapse_per_source,
    fingerprint,
    rank_fuse,
    rank_merge,
    rank_state,
    vote_fuse,
    vote_fuse_float,
    vote_merge,
    vote_share,
    vote_state,
    vote_winner,
)
from corrobora.operators.silver import gold_panel, silver_labels
from corrobora.operators.trust import adjudicate, hit_rate, join_trust, trust_counts, trust_table
from corrobora.plans.methods import budget_curve, compare_methods, em_truth, prepare
from corrobora.schema import CLAIMS, GROUP, POLICY, validate_claims
from corrobora.session import pin
from corrobora.streaming.live import LiveFusion

__all__ = [
    "CLAIMS",
    "GROUP",
    "LiveFusion",
    "POLICY",
    "abstain",
    "adjudicate",
    "budget_curve",
    "collapse_per_source",
    "compare_methods",
    "connected_components",
    "em_truth",
    "fingerprint",
    "gold_panel",
    "hit_rate",
    "join_trust",
    "pin",
    "prepare",
    "rank_fuse",
    "rank_merge",
    "rank_state",
    "silver_labels",
    "trust_counts",
    "trust_table",
    "validate_claims",
    "vote_fuse",
    "vote_fuse_float",
    "vote_merge",
    "vote_share",
    "vote_state",
    "vote_winner",
]
