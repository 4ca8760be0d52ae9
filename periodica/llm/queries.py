"""One query per operator of this package, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, exact_dedup, pii, quality_knn, recurrent_lm, sharding, simhash, substring_dedup, suffix_array


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Only for this query: a real run reads its key from a secret store.
QUERY_KEY = "demonstration key"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), QUERY_KEY)


def op2_de_bruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_words(_table(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), words=4, distance=4)


def op4_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(_table(spark, sf_dir, "documents"), shards=8)


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score_documents(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array.dedup_bytes(_table(spark, sf_dir, "documents"), width=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_feistel_pseudonyms, op2_de_bruijn_dedup, op3_simhash, op4_interleave, op5_template_decontamination, op6_quality_knn, op7_recurrent_lm, op8_suffix_dedup, op9_exact_dedup, op10_byte_bpe)}


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


#: Words by a set of the six white-space characters; a window is a list slice.
OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20),
m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM m WHERE k > 1),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT doc_id, len(words) AS n, coalesce(len(gone), 0) AS r, [words[i] FOR i IN range(1, len(words) + 1) IF NOT coalesce(list_contains(gone, i), false)] AS kept
      FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


#: Bytes as pairs of hexadecimal digits; a 100-byte string is 200 of these.
OP8_SQL = r"""
WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, unnest(range(0, n - 99)) AS i, hx FROM w WHERE n >= 100),
h AS (SELECT doc_id, i, md5(substr(hx, 2 * i + 1, 200)) AS h FROM s),
l AS (SELECT doc_id, i FROM h QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
g AS (SELECT *, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY ALL),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
k AS (SELECT doc_id, string_agg(substr(hx, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept, max(b) AS last, count(*) AS n_spans, sum(b - a) AS n_removed FROM p JOIN w USING (doc_id) GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept || substr(hx, 2 * last + 1), hx))) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_de_bruijn_dedup": OP2_SQL, "op8_suffix_dedup": OP8_SQL, "op9_exact_dedup": OP9_SQL}
