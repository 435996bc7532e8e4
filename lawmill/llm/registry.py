"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from lawmill.llm.embedding_tiles import op3_embedding_tiles
from lawmill.llm.filter_audit import op12_filter_audit
from lawmill.llm.language_mixture import op5_language_mixture
from lawmill.llm.latent_leaks import op10_latent_leaks
from lawmill.llm.license_join import op9_license_join
from lawmill.llm.merkle_manifest import op11_merkle_manifest
from lawmill.llm.mixing import op8_source_mix
from lawmill.llm.oracles import ORACLES
from lawmill.llm.quality import op6_quality_ftrl
from lawmill.llm.simhash import op7_simhash
from lawmill.llm.streaming_bpe import op13_streaming_bpe
from lawmill.llm.substring_runs import op4_substring_runs
from lawmill.llm.suffix_tree import op2_suffix_tree
from lawmill.llm.token_bins import op1_token_bins

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_bins,
        op2_suffix_tree,
        op3_embedding_tiles,
        op4_substring_runs,
        op5_language_mixture,
        op6_quality_ftrl,
        op7_simhash,
        op8_source_mix,
        op9_license_join,
        op10_latent_leaks,
        op11_merkle_manifest,
        op12_filter_audit,
        op13_streaming_bpe,
    )
}
__all__ = ["ORACLES", "QUERIES"]
