"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import crf, lattice, licenses, minhash, ogg, packing, ppm, sstable, suffix, transducer

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_ogg_media": ogg.op2_ogg_media,
    "op3_minhash": minhash.op3_minhash,
    "op4_sstable": sstable.op4_sstable,
    "op5_ppm": ppm.op5_ppm,
    "op6_toxicity": crf.op6_toxicity,
    "op7_lattice": lattice.op7_lattice,
    "op8_packing": packing.op8_packing,
    "op9_line_dedup": suffix.op9_line_dedup,
    "op10_sentencepiece": transducer.op10_sentencepiece,
}

ORACLES = {
    "op1_license_scan": licenses.oracle(),
    "op9_line_dedup": suffix.oracle(),
}
