"""Operations of a training-data pipeline over documents and embeddings; nothing else in the library uses them."""

from __future__ import annotations

from . import op1_secrets, op2_simhash, op3_repeats, op4_quality, op5_packing, op6_sharding, op7_records, op8_lattice, op9_langid, op10_mixing, op11_spelling, op12_dualtree, op13_multiprobe

_MODULES = (op1_secrets, op2_simhash, op3_repeats, op4_quality, op5_packing, op6_sharding, op7_records, op8_lattice, op9_langid, op10_mixing, op11_spelling, op12_dualtree, op13_multiprobe)

#: query -> function of (spark, sf_dir): each module has the one of its own name
QUERIES = {name: getattr(m, name) for m in _MODULES for name in [m.__name__.rpartition(".")[2]]}
#: query -> DuckDB SQL with the same result, where SQL can express it; the others are tested against brute force
ORACLES: dict[str, str] = {name: m.SQL for m in _MODULES if hasattr(m, "SQL") for name in [m.__name__.rpartition(".")[2]]}
