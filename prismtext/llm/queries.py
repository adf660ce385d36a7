"""One query for each corpus operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from .common import documents
from .conversations import op11_conversations
from .divergence import OP13_SQL, op13_divergence
from .fingerprints import op1_fingerprint
from .jaccard import op7_jaccard
from .langid import op9_language
from .lm_score import op6_lm_score
from .media import op2_media
from .mixing import OP10_SQL, op10_mix
from .packing import op12_packing
from .pieces import op5_pieces
from .suffix_dedup import op4_suffix_dedup
from .token_files import op8_token_files
from .toxicity import op3_toxicity

QUERIES = {
    "op1_fingerprint": lambda spark, sf_dir: op1_fingerprint(documents(spark, sf_dir)),
    "op2_media": lambda spark, sf_dir: op2_media(documents(spark, sf_dir)),
    "op3_toxicity": lambda spark, sf_dir: op3_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op4_suffix_dedup": lambda spark, sf_dir: op4_suffix_dedup(documents(spark, sf_dir)),
    "op5_pieces": lambda spark, sf_dir: op5_pieces(documents(spark, sf_dir)),
    "op6_lm_score": lambda spark, sf_dir: op6_lm_score(documents(spark, sf_dir)),
    "op7_jaccard": lambda spark, sf_dir: op7_jaccard(documents(spark, sf_dir)),
    "op8_token_files": lambda spark, sf_dir: op8_token_files(documents(spark, sf_dir)),
    "op9_language": lambda spark, sf_dir: op9_language(documents(spark, sf_dir)),
    "op10_mix_sources": lambda spark, sf_dir: op10_mix(documents(spark, sf_dir)),
    "op11_conversations": lambda spark, sf_dir: op11_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    "op12_packing": lambda spark, sf_dir: op12_packing(documents(spark, sf_dir)),
    "op13_divergence": lambda spark, sf_dir: op13_divergence(documents(spark, sf_dir)),
}

SQL = {"op10_mix_sources": OP10_SQL, "op13_divergence": OP13_SQL}
