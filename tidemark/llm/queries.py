"""The registered queries of the training-data operators, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    fm_index, language_model, licenses, mixing, neighbours, ngram_join, packing, quality, sharding, sketch, spelling, suffixes, vector_codes,
)
from tidemark.llm.tables import documents, written

Query = Callable[[SparkSession, str], DataFrame]


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget of words per source, weights 5, 2, 1, no document more than three times."""
    return mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), most=3.0)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector, by cosine."""
    return neighbours.nearest(documents(spark, sf_dir, "embeddings"), queries="vec_id % 50 = 0", k=5)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents with coverage and span."""
    return licenses.scanned(documents(spark, sf_dir))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text under word counts and under the attention model."""
    return language_model.scored(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled sketches of every text and of the text with its last quarter replaced."""
    return sketch.fingerprints(documents(spark, sf_dir))


def op7_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids beside their lexical neighbours."""
    return packing.packed(documents(spark, sf_dir), window=2048)


def op8_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail chances of every document; the model learns from ``labels``."""
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, quality.ratings_of(documents(spark, sf_dir, "labels")), n_grades=3)
    return quality.graded(docs, model)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a document of smaller id has too, 50 in a row.

    No id is smaller than a null one, as in the SQL.
    """
    return suffixes.deduplicated(documents(spark, sf_dir), window=50, with_kept=False, none_last=False).drop("kept")


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS s FROM d),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS k FROM starts),
f AS (SELECT k, min(doc_id) AS first_doc FROM w GROUP BY k),
r AS (SELECT w.doc_id, w.s FROM w JOIN f USING (k) WHERE f.first_doc < w.doc_id),
g AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM g),
spans AS (SELECT doc_id, span, min(s) AS a, max(s) + 50 AS b FROM i GROUP BY doc_id, span),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
k AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head,
        max(b) AS last_b, sum(b - a) AS gone, count(*) AS n
      FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last_b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside all 35-word stretches that occur again anywhere."""
    return fm_index.deduplicated(documents(spark, sf_dir), window=35, with_kept=False).drop("kept")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS stretch FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY stretch) AS c FROM k) WHERE c > 1),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
marked AS (SELECT words.doc_id, word, j, coalesce(j - r.i <= 34, false) AS gone
           FROM words ASOF LEFT JOIN r ON words.doc_id = r.doc_id AND words.j >= r.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS rest
         FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal documents: Jaccard similarity of 3-word shingles of at least 0.9."""
    return ngram_join.joined(documents(spark, sf_dir), n=3, percent=90)


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM places),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: 8 parts, 16 entries each, 6 rounds over integers of scale 4096."""
    vectors = documents(spark, sf_dir, "embeddings")
    books = vector_codes.train(vectors, parts=8, entries=16, rounds=6, scale=4096)
    coded = written(vector_codes.encoded(vectors, books, carry=["vec_id", "label"]), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return (
        coded.alias("c").join(by_label.alias("l"), F.expr("c.label <=> l.label"))
        .select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).alias("codebooks_sha256"))
    )


def _op11_sql(rounds: int = 6) -> str:
    """One statement per round: distances to all entries, then floors of means."""
    nearest = """
a{i} AS MATERIALIZED (
  SELECT vec_id, part, x, label, min({{'d': CAST(list_sum(list_transform(list_zip(x, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': entry}}) AS m
  FROM p JOIN c{i} AS c USING (part) GROUP BY vec_id, part, x, label)"""
    moved = """,
s{i} AS (SELECT part, m.e AS entry, pos, sum(v)::BIGINT AS s, count(*) AS n
         FROM (SELECT part, m, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY ALL),
n{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS e FROM s{i} GROUP BY ALL),
c{j} AS MATERIALIZED (SELECT part, entry, coalesce(n{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN n{i} USING (part, entry)),"""
    steps = "".join((nearest + moved).format(i=i, j=i + 1) for i in range(rounds)) + nearest.format(i=rounds)
    return f"""
WITH k AS (SELECT vec_id, label, embedding AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, label, unnest(range(0, 8)) AS part, len(v) // 8 AS n, v FROM k),
p AS MATERIALIZED (SELECT vec_id, label, part,
       list_transform(v[part * n + 1 : (part + 1) * n], lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM q),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e
       FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16)),{steps},
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
      FROM (SELECT part, entry, unnest(e) AS v, generate_subscripts(e, 1) AS pos FROM c{rounds})),
r AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, h
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 6 letters and 5 occurrences, the near word each is a form of, and its root."""
    return spelling.variants(documents(spark, sf_dir), shortest=6, least=5, one_in=199, ratio=5)


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+') AS w FROM documents),
o AS (SELECT doc_id, unnest(w) AS w FROM d),
u AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, w, c, concat(doc_id, ':', w) AS m
                   FROM (SELECT doc_id, w, count(*) AS c FROM o WHERE length(w) >= 6 GROUP BY ALL)),
bits(i, b, c) AS (SELECT 0, range, range FROM range(256) UNION ALL
                  SELECT i + 1, b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE i < 8),
crc AS MATERIALIZED (SELECT b, c FROM bits WHERE i = 8),
longest AS (SELECT max(strlen(m)) AS n FROM u),
t(k, b, c) AS (SELECT 0, b, c FROM crc UNION ALL
               SELECT k + 1, t.b, xor(t.c >> 8, crc.c) FROM t JOIN crc ON crc.b = t.c & 255 WHERE k < (SELECT n FROM longest)),
z(k, c) AS (SELECT 0, 4294967295 UNION ALL SELECT k + 1, xor(z.c >> 8, crc.c) FROM z JOIN crc ON crc.b = z.c & 255 WHERE k < (SELECT n FROM longest)),
x AS (SELECT id, hex(encode(m)) AS h, unnest(range(0, strlen(m))) AS i, strlen(m) AS n FROM u),
y AS (SELECT id, n, n - 1 - i AS k, CAST(concat('0x', substr(h, 2 * i + 1, 2)) AS INT) AS b FROM x),
hashed AS (SELECT id, xor(xor(bit_xor(t.c), any_value(z.c)), 4294967295) AS h FROM y JOIN t ON t.k = y.k AND t.b = y.b JOIN z ON z.k = y.n GROUP BY id),
cut AS (SELECT c, CASE WHEN doc_id IS NOT NULL AND h % 199 = 0
                       THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word
        FROM u JOIN hashed USING (id)),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
e AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
keys AS (SELECT word, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM e),
pairs AS (SELECT p.word, q.word AS near FROM keys AS p JOIN keys AS q ON p.a = q.a AND p.b = q.b AND p.word <> q.word
          UNION SELECT k.word, v.word FROM keys AS k JOIN v ON v.word = k.a || k.b
          UNION SELECT v.word, k.word FROM keys AS k JOIN v ON v.word = k.a || k.b),
ranked AS (SELECT pairs.word, near, v.n AS near_n, count(*) OVER (PARTITION BY pairs.word) AS n_near,
                  row_number() OVER (PARTITION BY pairs.word ORDER BY v.n DESC, near) AS r FROM pairs JOIN v ON v.word = near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
      FROM v LEFT JOIN ranked ON ranked.word = v.word AND r = 1),
chain(word, last, form) AS (SELECT word, word, form FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.form)
SELECT f.word, f.form, chain.last AS root, n, n_near, form_n FROM f JOIN chain ON chain.word = f.word AND chain.form IS NULL
"""


def op13_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a uniform order over 16 shards whose row counts are at most one apart."""
    rows = sharding.shuffled(sharding.digests(documents(spark, sf_dir)), shards=16)
    return rows.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def queries() -> dict[str, Query]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_substring_dedup": OP6_SQL,
        "op9_ngram_join": OP9_SQL,
        "op10_suffix_dedup": OP10_SQL,
        "op11_vector_codes": _op11_sql(),
        "op12_spelling_variants": OP12_SQL,
    }
