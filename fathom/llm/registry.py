"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from fathom.llm.automaton import op11_bpe
from fathom.llm.jaccard import OP3_SQL, op3_jaccard
from fathom.llm.licenses import OP1_SQL, op1_licenses
from fathom.llm.media import op5_media
from fathom.llm.mixing import op2_mixing
from fathom.llm.negatives import OP13_SQL, op13_negatives
from fathom.llm.packing import op9_packing
from fathom.llm.periods import op12_periods
from fathom.llm.pii import op6_pii
from fathom.llm.sentences import op4_sentences
from fathom.llm.simhash import op10_simhash
from fathom.llm.suffixes import OP7_SQL, op7_suffixes
from fathom.llm.toxicity import op8_toxicity

Query = Callable


def queries() -> dict[str, Query]:
    return {
        "op1_licenses": op1_licenses,
        "op2_mixing": op2_mixing,
        "op3_jaccard": op3_jaccard,
        "op4_sentences": op4_sentences,
        "op5_media": op5_media,
        "op6_pii": op6_pii,
        "op7_suffixes": op7_suffixes,
        "op8_toxicity": op8_toxicity,
        "op9_packing": op9_packing,
        "op10_simhash": op10_simhash,
        "op11_bpe": op11_bpe,
        "op12_periods": op12_periods,
        "op13_negatives": op13_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": OP1_SQL, "op3_jaccard": OP3_SQL, "op7_suffixes": OP7_SQL, "op13_negatives": OP13_SQL}
