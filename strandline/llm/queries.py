"""The registered queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline

from .audio import op2_audio_features
from .jaccard_join import OP8_SQL, op8_ngram_jaccard_join
from .language import op10_language_id
from .licenses import op1_license_scan
from .neardup_vectors import OP5_SQL, op5_embedding_dedup
from .packing import op9_best_fit_packing
from .pieces import op4_sentencepiece
from .quality import op6_quality
from .toxicity import op7_toxicity
from .warc import OP3_SQL, op3_warc

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_audio_features, op3_warc, op4_sentencepiece, op5_embedding_dedup, op6_quality, op7_toxicity, op8_ngram_jaccard_join, op9_best_fit_packing, op10_language_id)}
ORACLE_SQL: dict[str, str] = {"op3_warc": OP3_SQL, "op5_embedding_dedup": OP5_SQL, "op8_ngram_jaccard_join": OP8_SQL}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
