"""All queries of the subpackage; importing the modules fills the registry."""

from meetlake.llm import (  # noqa: F401
    bpe, html_main, lexical, merkle, mixing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, topk, warc, window_dedup,
)
from meetlake.llm.registry import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS"]
