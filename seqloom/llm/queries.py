"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, divergence, language, lines, mixing, neighbours, quality, sharding, simhash, token_files, url_filter, warc
from .common import Scratch, doc_key, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def sha256_of_ids(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def bpe_options() -> dict[str, str]:
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = bpe_options()
    ids = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), **bpe).drop("text")
    decoded = byte_bpe.decode(ids, **bpe)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_of_ids(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES["op9_byte_bpe"] = op9_byte_bpe


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op8_mixing"] = op8_mixing

_DRAWN = ", ".join(f"('0x' || substr(md5('mix{k // 4}:' || doc_id::varchar), {8 * (k % 4) + 1}, 8))::bigint / 4294967296.0" for k in range(mixing.DRAWS))
ORACLE["op8_mixing"] = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size, [{_DRAWN}] AS u
  FROM documents),
sources AS (SELECT source, sum(size)::bigint AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::double, 2.0::double, 1.0::double][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::double AS most FROM sources),
levels AS (
  SELECT *, most / weight AS full_at,
    (1.5::double * sum(source_size) OVER ()::double - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT source, source_size, least(most, (SELECT max(level) FROM levels WHERE level <= full_at) * weight) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
drawn AS (
  SELECT s.doc_id, s.size, s.u, r.* FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
tried AS (
  SELECT source, k, abs(any_value(floor(rate) * source_size) + sum(CASE WHEN u[k] < rate - floor(rate) THEN size ELSE 0 END) - any_value(target)) AS miss
  FROM drawn, range(1, {mixing.DRAWS + 1}) AS t(k) GROUP BY source, k),
chosen AS (SELECT source, arg_min(k, (miss, k)) AS k FROM tried GROUP BY source)
SELECT d.doc_id, d.size, d.source_size, d.target, (d.size * (floor(rate) + CASE WHEN u[c.k] < rate - floor(rate) THEN 1 ELSE 0 END))::bigint AS taken
FROM drawn d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source"""


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import zlib

    import public_tokenizers

    scratch = Scratch(spark, "tokens")
    path = scratch.path("files")
    written = token_files.write(table(spark, sf_dir, "documents"), path, vocabulary=public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    manifest = scratch.keep(written, "manifest")
    return token_files.read(spark, path, manifest, digest=zlib.crc32).withColumnRenamed("digest", "ids_crc32")


QUERIES["op10_token_files"] = op10_token_files


#: Shards of the production set-up.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.place(docs, doc_key(F.col("doc_id"), F.col("text")), SHARDS).select("doc_id", "slot", "shard")


QUERIES["op1_sharding"] = op1_sharding


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op7_warc"] = op7_warc

ORACLE["op7_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::bigint AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM firsts"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES["op6_simhash"] = op6_simhash


def held_out(doc_id: Column) -> Column:
    """Documents that language identification doesn't learn from; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, ~held_out(F.col("doc_id")))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES["op3_language"] = op3_language


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), with_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES["op4_quality"] = op4_quality

_LIMITS = quality.Limits()
_CLASS_SQL = ", ".join("length(t) - length(regexp_replace(t, '[{}]', '', 'g'))".format(x.replace("'", "''")) for x in quality.CLASSES.values())
_HALF = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END".format
ORACLE["op4_quality"] = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 3) AS r(k) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, lang, t, ws, len(ws)::bigint AS n_words, coalesce(length(array_to_string(ws, '')), 0)::bigint AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
    coalesce(ln.n, 0)::bigint AS n_dup_lines, coalesce(cov.n, 0)::bigint AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
marks AS (SELECT doc_id, lang, length(t) AS n, [{_CLASS_SQL}, length(t) - word_chars] AS c FROM base),
bins AS (SELECT doc_id, lang, n, unnest(list_concat(c, [n - list_sum(c)])) AS c, generate_subscripts(list_concat(c, [n]), 1) AS k FROM marks),
sums AS (SELECT lang, k, sum(c) AS c FROM bins WHERE lang IS NOT NULL GROUP BY lang, k UNION ALL SELECT NULL, k, sum(c) FROM bins GROUP BY k),
ref AS (SELECT lang, k, c / sum(c) OVER (PARTITION BY lang) AS q FROM sums),
cd AS (SELECT doc_id, sqrt(greatest(sum(({_HALF("(c / n)", "q")} + {_HALF("q", "(c / n)")}) / 2), 0)) AS class_distance FROM bins b JOIN ref ON b.lang IS NOT DISTINCT FROM ref.lang AND b.k = ref.k WHERE n > 0 GROUP BY doc_id),
wn AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+')) AS word FROM d) GROUP BY lang, word),
wc AS (SELECT * FROM wn WHERE lang IS NOT NULL UNION ALL SELECT NULL, word, sum(n) FROM wn GROUP BY word),
top AS (SELECT lang, word, n / total AS q FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place, sum(n) OVER (PARTITION BY lang) AS total FROM wc) WHERE place <= {_LIMITS.common}),
dw AS (SELECT doc_id, lower(word) AS word, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY ALL),
met AS (SELECT b.doc_id, q, coalesce(c, 0) / greatest(n_words, 1) AS p FROM base b JOIN top ON b.lang IS NOT DISTINCT FROM top.lang LEFT JOIN dw ON dw.doc_id = b.doc_id AND dw.word = top.word),
rest AS (SELECT * FROM met UNION ALL SELECT doc_id, greatest(1 - sum(q), 0), 1 - sum(p) FROM met GROUP BY doc_id),
wd AS (SELECT doc_id, sqrt(greatest(sum(({_HALF("p", "q")} + {_HALF("q", "p")}) / 2), 0)) AS word_distance FROM rest GROUP BY doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (length(t) < {_LIMITS.min_chars} OR class_distance <= {_LIMITS.class_distance}) AND (n_words < {_LIMITS.min_words} OR word_distance <= {_LIMITS.word_distance}) AS kept
FROM judged LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id)"""


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES["op2_neighbours"] = op2_neighbours


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op5_lines"] = op5_lines


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES["op13_divergence"] = op13_divergence

_SHARE_SQL = "(1 + (1000000000::hugeint * ({n} + 5)) // ({total} + 5 * v))".format
ORACLE["op13_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (
  SELECT lang, source, coalesce(any_value(x.n), 0) AS total, coalesce(any_value(vs.v), 0) AS v FROM (SELECT DISTINCT lang, source FROM d) s
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) x USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) vs USING (lang) GROUP BY ALL),
l AS (SELECT lang, sum(total) AS whole FROM g GROUP BY lang),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE_SQL(n="coalesce(c.n, 0)", total="total")} AS p FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, any_value({_SHARE_SQL(n="cn", total="whole")}) AS q FROM (SELECT lang, term, sum(n) AS cn FROM c GROUP BY ALL) JOIN l USING (lang) JOIN g USING (lang) GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::bigint AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q)::bigint AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    named = found.select("cluster", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"))
    each = sums.join(F.broadcast(named), "cluster")  # a row for each centroid
    whole = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    joined = assigned.join(F.broadcast(each), "cluster").join(F.broadcast(whole))  # as few, and one row
    return joined.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES["op12_centroids"] = op12_centroids


def _centroids_sql(dimension: int = 64, k: int = 40, rounds: int = 5) -> str:
    """A CTE for each round: nearest centroids by arg_min, means rounded down."""
    steps = [
        f"vs AS MATERIALIZED (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension})",
        "xs AS MATERIALIZED (SELECT vec_id, unnest(range(0, len(e))) AS j, floor(256 * unnest(e)::double)::bigint AS x FROM vs)",
        f"c0 AS MATERIALIZED (SELECT c, j, x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id::varchar)) - 1 AS c FROM vs QUALIFY c < {k}) JOIN xs USING (vec_id))",
    ]
    for turn in range(rounds + 1):
        steps.append(f"a{turn} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c, sum((xs.x - c{turn}.x) * (xs.x - c{turn}.x))::bigint AS d FROM xs JOIN c{turn} USING (j) GROUP BY vec_id, c) GROUP BY vec_id)")
        if turn < rounds:
            steps.append(f"m{turn} AS (SELECT c, j, sum(x)::bigint AS s, count(*) AS n FROM a{turn} JOIN xs USING (vec_id) GROUP BY c, j)")
            steps.append(f"c{turn + 1} AS MATERIALIZED (SELECT c, j, coalesce((m{turn}.s - ((m{turn}.s % n) + n) % n) // n, c{turn}.x)::bigint AS x FROM c{turn} LEFT JOIN m{turn} USING (c, j))")
    return f"""WITH {", ".join(steps)},
shown AS (SELECT c, sha256(string_agg(x::varchar, ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, c::int AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::bigint AS cluster_inertia, (sum(d) OVER ())::bigint AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN shown USING (c)"""


ORACLE["op12_centroids"] = _centroids_sql()


#: The rules of the production set-up.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


QUERIES["op11_url_filter"] = op11_url_filter


def _url_filter_sql(limits: url_filter.Limits = url_filter.Limits()) -> str:
    """A group of CTEs for each level of the trees."""
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')".format
    rules = [(text, what, *text.split("/", 1)) for what, text in sorted(URL_RULES, key=lambda r: -len(r[1]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[2], '/' + r[3])} THEN '{r[k]}'" for r in rules) + " END"
    smooth, z = f"{limits.smooth}::double", f"{limits.z}::double"
    steps = [
        f"u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{url_filter.URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '{url_filter.URL}', 2) AS path FROM pages)",
        f"j AS MATERIALIZED (SELECT *, {case(0)} AS rule, {case(1)} AS label, regexp_replace(path, '[0-9]+', '#', 'g') AS pattern FROM u)",
        "ps AS MATERIALIZED (SELECT host, pattern, count(*) AS n, count(*) FILTER (label = 'allow') AS allow, count(*) FILTER (label = 'block') AS block FROM j GROUP BY ALL)",
        "o AS (SELECT (coalesce(sum(block), 0)::double + 1) / (coalesce(sum(allow), 0)::double + coalesce(sum(block), 0)::double + 2) AS g FROM ps)",
        f"l0 AS MATERIALIZED (SELECT host, '' AS node, pattern, CASE WHEN pattern = '' THEN [] ELSE string_split(substr(pattern, 2), '/') END AS s, n, allow, block, (sum(block) OVER w + {smooth} * (SELECT g FROM o)) / (sum(allow) OVER w + sum(block) OVER w + {smooth}) AS purity FROM ps WINDOW w AS (PARTITION BY host))",
    ]
    for i in range(limits.depth):
        steps += [
            f"b{i} AS (SELECT *, s[{i + 1}] AS segment, sum(n) OVER (PARTITION BY host, node, s[{i + 1}]) AS own, sum(n) OVER (PARTITION BY host, node) AS total FROM l{i} WHERE len(s) > {i})",
            f"k{i} AS MATERIALIZED (SELECT *, CASE WHEN own * {limits.share} >= total AND own >= {limits.least} THEN segment ELSE '*' END AS branch FROM b{i})",
            f"""m{i} AS (SELECT *, CASE WHEN m > 0 THEN block::double / m ELSE 0 END AS rate FROM (SELECT host, node, branch, any_value(purity) AS purity, sum(block)::bigint AS block, sum(allow + block)::bigint AS m,
              sum(CASE WHEN len(s) <= {i + 1} THEN n ELSE 0 END)::double / sum(n)::double AS ended, sum(CASE WHEN contains(s[{i + 2}], '#') THEN n ELSE 0 END)::double / sum(n)::double AS numbered FROM k{i} GROUP BY host, node, branch))""",
            f"n{i} AS (SELECT *, lag(m) OVER w AS pm, lag(block) OVER w AS pb, lag(rate) OVER w AS pr, lag(ended) OVER w AS pe, lag(numbered) OVER w AS pn, m > 0 AS f, CASE WHEN ended >= 0.5 THEN 0 WHEN numbered >= 0.5 THEN 1 ELSE 2 END AS kind FROM m{i} WINDOW w AS (PARTITION BY host, node ORDER BY m > 0, CASE WHEN ended >= 0.5 THEN 0 WHEN numbered >= 0.5 THEN 1 ELSE 2 END, rate, branch))",
            f"""d{i} AS (SELECT *, CASE WHEN pm IS NULL OR abs(ended - pe) > {limits.shape} OR abs(numbered - pn) > {limits.shape} OR f <> (pm > 0)
              OR (m > 0 AND (rate - pr) * (rate - pr) > {z} * {z} * ((block + pb)::double / (m + pm)) * (1 - (block + pb)::double / (m + pm)) * (1.0::double / m + 1.0::double / pm)) THEN 1 ELSE 0 END AS new FROM n{i})""",
            f"e{i} AS (SELECT *, sum(new) OVER (PARTITION BY host, node ORDER BY f, kind, rate, branch) AS part FROM d{i})",
            f"g{i} AS MATERIALIZED (SELECT host, node, branch, list_aggregate(list_sort(list(branch) OVER w), 'string_agg', '|') AS name, (sum(block) OVER w + {smooth} * purity) / (sum(m) OVER w + {smooth}) AS purity FROM e{i} WINDOW w AS (PARTITION BY host, node, part))",
            f"l{i + 1} AS MATERIALIZED (SELECT host, node || '/' || name AS node, pattern, s, n, allow, block, g{i}.purity FROM k{i} JOIN g{i} USING (host, node, branch))",
        ]
    every = " UNION ALL ".join(f"SELECT host, pattern, purity FROM l{i} WHERE len(s) = {i}" if i < limits.depth else f"SELECT host, pattern, purity FROM l{i}" for i in range(limits.depth + 1))
    return f"""WITH {", ".join(steps)},
t AS ({every})
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN purity > {limits.reject} THEN 'block' ELSE 'allow' END) AS verdict FROM j JOIN t USING (host, pattern)"""


ORACLE["op11_url_filter"] = _url_filter_sql()
