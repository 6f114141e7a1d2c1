"""The queries of this package, and their SQL where SQL can say them."""

from __future__ import annotations

from terrafold.llm.bitplanes import op4_bitplanes
from terrafold.llm.dual_tree import OP12_SQL, op12_dual_tree
from terrafold.llm.filter_audit import OP13_SQL, op13_filter_audit
from terrafold.llm.langid import op2_langid
from terrafold.llm.media import op6_flac
from terrafold.llm.merkle import OP5_SQL, op5_merkle
from terrafold.llm.mixing import OP8_SQL, op8_mix
from terrafold.llm.ngram_join import op7_ngram_join
from terrafold.llm.packing import op9_packing
from terrafold.llm.repeats import op3_repeats
from terrafold.llm.secrets import OP10_SQL, op10_secrets
from terrafold.llm.sharding import OP11_SQL, op11_sharding
from terrafold.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_langid": op2_langid,
    "op3_repeats": op3_repeats,
    "op4_bitplanes": op4_bitplanes,
    "op5_merkle": op5_merkle,
    "op6_flac": op6_flac,
    "op7_ngram_join": op7_ngram_join,
    "op8_mix": op8_mix,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
    "op11_sharding": op11_sharding,
    "op12_dual_tree": op12_dual_tree,
    "op13_filter_audit": op13_filter_audit,
}

SQL = {
    "op5_merkle": OP5_SQL,
    "op8_mix": OP8_SQL,
    "op10_secrets": OP10_SQL,
    "op11_sharding": OP11_SQL,
    "op12_dual_tree": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
