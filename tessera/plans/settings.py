"""Constants of the lift model and the knobs of each stage, as one frozen value that is passed, never global state."""

from __future__ import annotations

from dataclasses import dataclass, field

# Labels, multipliers and bands that results depend on.
LIFT_OF = {"ruled_out": 0.02, "much_less": 0.2, "less": 0.5, "unchanged": 1.0, "more": 2.0, "much_more": 5.0}
GUARANTEED = "guaranteed"
GUARANTEED_POSTERIOR = 0.97
LIFT_RANGE = (1e-3, 20.0)
PRIOR_RANGE = (1e-3, 0.99)
DEFAULT_PRIOR = 0.5
#: Lower edges of the verdicts over log lift, from the lowest.
VERDICTS = (("strongly_contradicts", None), ("contradicts", -1.0), ("neutral", -0.3), ("supports", 0.3), ("strongly_supports", 1.0))
#: Words that the lexical oracle and the structural screen pass over.
ORACLE_STOP = tuple("the a an of to and or is are was were in on at for with by from this that it its as be been being their his her they he she we you i".split())
SCREEN_STOP = (*ORACLE_STOP, "not", "no")
#: Phrases that make the lexical oracle take a statement as negative, or as rare.
NEGATIVE_CUES = ("no ", "not ", "without", "within specification", "no signal", "no abnormalities", "within normal", "denied", "ruled out", "no faults", "stable", "unchanged")
RARE_CUES = ("only", "exactly", "precisely", "23-minute", "14x", "420%", "34 of 96")
#: The lexical oracle's proposal, around the commonest words of a cluster.
PROPOSAL = ("A common underlying factor involving ", " explains these observations.")
#: Fixed value: what marks a near copy of an episode.
DUPLICATE_MARK = " (duplicate record from a second system)."
#: Patterns of sentence ends, of the words of the oracle and of the screen, and of entities.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"
ORACLE_WORD = "[a-z0-9]+"
SCREEN_WORD = "[a-z0-9][a-z0-9'-]+"
NAME = r"\b[A-Z][a-zA-Z-]{2,}\b"
FIGURE = r"\b\d{4}-\d{2}-\d{2}\b|\b\d+(?:[.,]\d+)?%?\b"
#: What a free prompt asks, and the phrases one group of which it has all of; the first kind in this order.
PROMPT_PHRASES = (
    ("atomize", (("Split the passage",), ("atomic", "propositions"))),
    ("abduce", (("Propose ONE single hypothesis",),)),
    ("joint_lift", (("taken TOGETHER as a single combined fact",),)),
)
#: The same for phrases in any case.
ANY_CASE_PHRASES = (("prior", (("base rate",), ("randomly chosen",))), ("relatedness", (("topically related",),)), ("lift", (("change", "scenario"),)))


@dataclass(frozen=True)
class Settings:
    """Knobs with the defaults of the lift model."""

    embed_dim: int = 256
    chunk_percentile: float = 0.25
    chunk_min_sentences: int = 1
    chunk_max_sentences: int = 8
    atom_min_chars: int = 10
    oracle_atom_chars: int = 15
    refute_lift: float = 0.25
    set_size: int = 5
    seeds: int = 3
    shortlist: int = 25
    residual_epsilon: float = 0.15
    min_cluster: int = 3
    dense_below: int = 20
    cluster_distance: float = 0.6
    support_lift: float = 1.5
    admit_share: float = 0.5
    entity_keys: tuple[str, ...] = field(default=("source", "shift", "oven", "supplier"))


DEFAULTS = Settings()
