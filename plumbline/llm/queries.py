"""Queries over the operators of this package, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .butterfly_manifest import digest, field, manifest
from .decontamination import contamination
from .filter_audit import filter_audit
from .harmonic_packing import pack
from .merkle_fixity import audit, warc_records
from .ngram_join import ngram_groups
from .pii_boosting import KINDS, spans
from .quality_ftrl import quality
from .rank_language import language
from .spot_signatures import fingerprints
from .suffix_boilerplate import main_text
from .toxicity_cnn import toxicity
from .vector_packing import pack as vector_pack


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(read(spark, sf_dir, "documents"))
    each = F.arrays_zip("kinds", "starts", "ends", "base").alias("each")

    def text(span) -> F.Column:
        return F.concat_ws(":", span["kinds"], span["starts"], span["ends"])

    def of(kind: str) -> F.Column:
        return F.size(F.filter(base, lambda s: s["kinds"] == kind)).cast("long")

    base = F.filter("each", lambda s: s["base"])
    return found.select("doc_id", each).select(
        "doc_id",
        *(of(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("each", text), ",").alias("spans"),
    )


def labelled(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return labels.select("doc_id", F.col(column).alias("label"))


def op3_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality(docs, labelled(spark, sf_dir, "quality"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(read(spark, sf_dir, "documents"))


def replica(pages: DataFrame) -> DataFrame:
    """The pages as a second archive might hold them: some changed, some lost."""
    kind = (F.col("page_id") * 7919 + 13) % 100
    html = F.col("html")
    changed = (
        F.when(kind < 2, F.translate(html, "ae", "ea"))
        .when(kind == 2, F.expr("substr(html, 1, length(html) - 7)"))
        .otherwise(html)
    )
    return pages.where(kind != 3).withColumn("html", changed)


def op5_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return audit(warc_records(pages), warc_records(replica(pages)))


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity(docs, labelled(spark, sf_dir, "toxic"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


def op9_rank_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return vector_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op13_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    leaf = [field(name) for name in ("doc_id", "source", "lang", "n_chars", "text")]
    # Lower case leaves the number of bytes as it is.
    lowered = F.translate("text", CAPITALS, CAPITALS.lower())
    told = F.concat(F.octet_length("text").cast("string"), F.lit(":"), lowered)
    tampered = [*leaf[:-1], F.coalesce(told, F.lit("-"))]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = manifest(
        docs, "doc_id", "source", digest(leaf), F.when(chosen, digest(tampered))
    ).audit()
    return found.withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id,
    array_to_string(w[i + 1 : i + least(len(w), 4)], ' ') AS shingle
  FROM d, unnest(range(greatest(len(w) - 4, 0) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""

OP5_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    (page_id * 7919 + 13) % 100 AS kind FROM pages),
q AS (
  SELECT page_id, kind, url, html AS one,
    CASE WHEN kind < 2 THEN translate(html, 'ae', 'ea')
      WHEN kind = 2 THEN substring(html, 1, length(html) - 7) ELSE html END AS two
  FROM p),
h AS (
  SELECT page_id, kind,
    concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: response',
      'WARC-Target-URI: ' || url, 'WARC-Record-ID: <urn:page:' || page_id || '>',
      'Content-Length: ' || strlen(one)) || repeat(chr(13) || chr(10), 2) || one
      || repeat(chr(13) || chr(10), 2) AS one,
    concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: response',
      'WARC-Target-URI: ' || url, 'WARC-Record-ID: <urn:page:' || page_id || '>',
      'Content-Length: ' || strlen(two)) || repeat(chr(13) || chr(10), 2) || two
      || repeat(chr(13) || chr(10), 2) AS two FROM q),
o AS (
  SELECT page_id // 4096 AS file, cast(page_id % 4096 AS integer) AS number,
    cast(coalesce(sum(strlen(one)) OVER (PARTITION BY page_id // 4096 ORDER BY page_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS "offset",
    cast(strlen(one) AS bigint) AS length, sha256(one) AS expected,
    CASE WHEN kind <> 3 THEN sha256(two) END AS found,
    CASE WHEN kind = 3 THEN 'missing' WHEN strlen(one) <> strlen(two) THEN 'resized'
      ELSE 'altered' END AS fault FROM h)
SELECT * FROM o WHERE found IS NULL OR found <> expected
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
t AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size,
    array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') AS phrase
  FROM b, unnest(range(greatest(len(w) - 13, 0) + 1)) AS r(i) WHERE len(w) > 0),
g AS (
  SELECT doc_id, i AS start, size, array_to_string(w[i + 1 : i + size], ' ') AS phrase
  FROM d, (SELECT DISTINCT size FROM t) s,
    unnest(range(greatest(len(w) - size + 1, 0))) AS r(i)),
h AS (SELECT DISTINCT doc_id, start, g.size, item_id
  FROM g JOIN t ON g.phrase = t.phrase AND g.size = t.size),
p AS (SELECT doc_id, count(DISTINCT start + k) AS n_hit
  FROM h, unnest(range(size)) AS r(k) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words,
  cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
  cast(coalesce(n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT doc_id, max((quality IS NOT NULL AND quality = 1)::int) AS good,
    max((toxic IS NOT NULL AND toxic = 1)::int) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 100)::int AS a,
    (100 * len(list_distinct(w)) < 80 * len(w))::int AS b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int AS c,
    regexp_matches(t, '[#$%&*|]')::int AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::int AS e
  FROM d LEFT JOIN l USING (doc_id)),
m AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n,
    sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM x p, x q, x r, x s, x t WHERE p.b | q.b | r.b | s.b | t.b = 31),
s AS (
  SELECT filter_order, step, x.x AS filter, x.b AS own, coalesce((
    SELECT sum(y.b) FROM x y WHERE position(y.x IN filter_order) < step), 0)::int AS earlier
  FROM o, range(1, 6) AS r(step), x WHERE x.x = filter_order[step]),
c AS (
  SELECT part, filter_order, step::int AS step, any_value(filter) AS filter,
    sum(CASE WHEN mask & (earlier | own) = 0 THEN n ELSE 0 END)::bigint AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN n ELSE 0 END)::bigint
      AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & own > 0 THEN n ELSE 0 END)::bigint
      AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::bigint AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN good ELSE 0 END)::bigint
      AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN toxic ELSE 0 END)::bigint
      AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step)
SELECT * EXCLUDE (filter),
  sum(removed) OVER (PARTITION BY part, filter)::bigint AS shapley FROM c
"""


def tree_sql(leaves: str, paths: str, name: str, levels: int) -> str:
    """Nodes of all levels over ``leaves (k, i, h)``; ``paths (r, k, j, f, p)`` with
    folded node and proof carried up through them, to ``{name}p``."""
    steps = [f"{name}0 AS (SELECT k, i, h FROM {leaves})", f"{name}a0 AS (FROM {paths})"]
    for n in range(levels):
        steps += [
            f"{name}b{n} AS (SELECT * FROM {name}{n} WHERE k IN "
            f"(SELECT k FROM {name}{n} GROUP BY k HAVING count(*) > 1))",
            f"{name}{n + 1} AS (SELECT k, i // 16 AS i, "
            f"sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}b{n} GROUP BY k, i // 16)",
            f"{name}a{n + 1} AS (SELECT a.r, any_value(a.k) AS k, any_value(a.j) // 16 AS j, "
            "coalesce(sha256(string_agg(CASE WHEN n.i = a.j THEN a.f ELSE n.h END, '' "
            "ORDER BY n.i)), any_value(a.f)) AS f, any_value(a.p) || coalesce(string_agg("
            "CASE WHEN n.i <> a.j THEN n.h END, '' ORDER BY n.i), '') AS p "
            f"FROM {name}a{n} a LEFT JOIN {name}b{n} n ON n.k = a.k "
            "AND n.i // 16 = a.j // 16 GROUP BY a.r)",
        ]
    roots = " UNION ALL ".join(
        f"SELECT k, any_value(h) AS h FROM {name}{n} GROUP BY k HAVING count(*) = 1"
        for n in range(levels + 1)
    )
    return ",\n".join([*steps, f"{name}r AS ({roots})", f"{name}p AS (FROM {name}a{levels})"])


def leaf_sql(text: str) -> str:
    columns = ["doc_id", "source", "lang", "n_chars", text]
    fields = [
        f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in columns
    ]
    return f"sha256({' || '.join(fields)})"


LOWERED = f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')"

OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, {leaf_sql("text")} AS h,
    {leaf_sql(LOWERED)} AS lowered,
    xor(list_reduce([4294967295] || list_transform(
      string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
      lambda crc, c: list_reduce([xor(crc, c)] || range(8),
        lambda x, n: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc FROM documents),
n AS (
  SELECT *, row_number() OVER (ORDER BY k, doc_id NULLS FIRST, h) AS r,
    row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
a AS (
  SELECT r, k, i AS j, CASE WHEN crc % 5 = 0 THEN lowered ELSE h END AS f, '' AS p FROM n),
{tree_sql("n", "a", "s", 5)},
u AS (SELECT 0 AS k, row_number() OVER (ORDER BY k) - 1 AS i, h, k AS key FROM sr),
b AS (SELECT sp.r, 0 AS k, u.i AS j, sp.f, sp.p FROM sp JOIN u ON u.key = sp.k),
{tree_sql("u", "b", "t", 3)}
SELECT doc_id, n.h AS leaf, sr.h AS subroot, tr.h AS root, sha256(tp.p) AS proof_sha256,
  tp.f AS folded_root, tp.f = tr.h AS verified
FROM n JOIN sr ON sr.k = n.k JOIN tp ON tp.r = n.r, tr
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_boilerplate": op1_suffix_boilerplate,
        "op2_pii_boosting": op2_pii_boosting,
        "op3_quality_ftrl": op3_quality_ftrl,
        "op4_ngram_join": op4_ngram_join,
        "op5_merkle_fixity": op5_merkle_fixity,
        "op6_spot_signatures": op6_spot_signatures,
        "op7_toxicity_cnn": op7_toxicity_cnn,
        "op8_harmonic_packing": op8_harmonic_packing,
        "op9_rank_language": op9_rank_language,
        "op10_decontamination": op10_decontamination,
        "op11_vector_packing": op11_vector_packing,
        "op12_filter_audit": op12_filter_audit,
        "op13_butterfly_manifest": op13_butterfly_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_join": OP4_SQL,
        "op5_merkle_fixity": OP5_SQL,
        "op10_decontamination": OP10_SQL,
        "op12_filter_audit": OP12_SQL,
        "op13_butterfly_manifest": OP13_SQL,
    }
