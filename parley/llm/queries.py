"""The registered query of each operator, with production parameters over its whole table, and SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import alignment, decontaminate, mixing, neighbours, quality, reputation, resampling, rules, simhash, substring, suffix_windows, tokens, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, 3 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_suffix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a 50-byte string of an earlier document covers."""
    found = suffix_windows.repeated_bytes(table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a 20-word window seen earlier covers."""
    return substring.repeated_words(table(spark, sf_dir, "documents"), length=20)


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back: equal payloads stored once, blocks cut at 64 KiB."""
    return warc.summary(warc.archive(table(spark, sf_dir, "pages"), at_least=0))


#: The rules of the production filter; ORACLES spells the same ones out.
RULES = (
    reputation.UrlRule("allow", "com", "/"), reputation.UrlRule("block", "example.com", "/en/"),
    reputation.UrlRule("allow", "www.example.com", "/en/"), reputation.UrlRule("block", "net", "/es/"),
    reputation.UrlRule("block", "net", "/fr/"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first, else the reputation of the host; a page's outcome is the quality label of the document its url names."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    named = pages.select("page_id", F.regexp_extract("url", "://[^/?#]*/[^/?#]*/([0-9]{1,18})", 1).alias("doc")).where("doc <> ''")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
    outcomes = named.join(marks, named["doc"].cast("long") == marks["doc_id"]).select("page_id", "good")
    found = reputation.judge(pages, outcomes, RULES, least=0.75, z=1.645)
    return found.select("page_id", "host", "path", "rule", "verdict")


def _shrunk(level: str, parent: str) -> str:
    """SQL of one level: rates drawn towards the parent's, with the weight by moments."""
    return f"""
{level}_k AS (SELECT least(1000.0, greatest(2.0, coalesce(CASE WHEN tau > 0 THEN base / tau - 1 ELSE 1000.0 END, 1000.0))) AS k FROM (
  SELECT (sum(n * (s / n - m) * (s / n - m)) - sum(m * (1 - m))) / nullif(sum(n) - sum(n * n) / sum(n), 0) AS tau, avg(m * (1 - m)) AS base
  FROM {level}_in WHERE n > 0) t),
{level}_out AS (SELECT {parent}, n, (s + k * m) / (n + k) AS rate, n + k AS seen FROM {level}_in, {level}_k)"""


ORACLES["op3_url_filter"] = f"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path,
    regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]{{1,18}})', 1) AS doc FROM cut),
marked AS (SELECT p.*, l.quality FROM parsed p LEFT JOIN labels l ON CAST(nullif(p.doc, '') AS BIGINT) = l.doc_id),
hosts AS (SELECT host, list_last(string_split(host, '.')) AS suffix,
    CASE WHEN contains(host, '.') THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS domain,
    CAST(count(quality) AS DOUBLE) AS n, CAST(coalesce(sum(quality), 0) AS DOUBLE) AS s FROM marked GROUP BY host),
suffix_in AS (SELECT suffix, sum(n) AS n, sum(s) AS s, (SELECT (sum(s) + 1) / (sum(n) + 2) FROM hosts) AS m FROM hosts GROUP BY suffix),
{_shrunk("suffix", "suffix")},
domain_in AS (SELECT domain, sum(h.n) AS n, sum(h.s) AS s, any_value(o.rate) AS m FROM hosts h JOIN suffix_out o USING (suffix) GROUP BY domain),
{_shrunk("domain", "domain")},
host_in AS (SELECT host, h.n, h.s, o.rate AS m FROM hosts h JOIN domain_out o USING (domain)),
{_shrunk("host", "host")},
ruled AS (SELECT p.page_id, p.host, p.path, o.rate, o.seen, CASE
    WHEN (p.host = 'www.example.com' OR ends_with(p.host, '.www.example.com')) AND starts_with(p.path, '/en/') THEN 'www.example.com/en/'
    WHEN (p.host = 'example.com' OR ends_with(p.host, '.example.com')) AND starts_with(p.path, '/en/') THEN 'example.com/en/'
    WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(p.path, '/es/') THEN 'net/es/'
    WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(p.path, '/fr/') THEN 'net/fr/'
    WHEN (p.host = 'com' OR ends_with(p.host, '.com')) AND starts_with(p.path, '/') THEN 'com/' END AS rule
  FROM parsed p JOIN host_out o USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN rate + 1.645 * sqrt(rate * (1 - rate) / (seen + 1)) < 0.75 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""

@query
def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files of the byte-level vocabulary, read back."""
    import public_tokenizers

    return tokens.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fifth."""
    found = quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents, within 6 edits in 100 characters."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), q=12, rate=0.06)


#: The production mix: which sources make up a domain, and the weights on each level.
DOMAINS = {"src0": "crawl"} | {f"src{n}": "books" for n in range(1, 10)} | {f"src{n}": "forum" for n in range(10, 20)}
WEIGHTS = {"domain": {"crawl": 5, "books": 3, "forum": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the production mix, a row for each epoch that takes one; up to two epochs."""
    documents = table(spark, sf_dir, "documents")
    found = mixing.mix(documents, DOMAINS, WEIGHTS, share=1.0, epochs=2, seed=7)
    return found.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_epoch").alias("epoch"))


def _level(name: str, path: list[str], weight: str, parent: str) -> str:
    """SQL of one level of the tree: shares by weight, shortages to the siblings."""
    over, keys = ", ".join(path[:-1]) or "1", ", ".join(path)
    total = f"{parent}" if len(path) == 1 else "p.budget"
    join = "" if len(path) == 1 else f"JOIN {parent} p USING ({over})"
    return f"""
{name}_0 AS (SELECT {keys}, sum(c.cap) AS cap, {weight} AS weight, any_value({total}) AS total FROM caps c {join} GROUP BY {keys}),
{name}_1 AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS used, sum(weight) OVER (PARTITION BY {over}) - coalesce(sum(weight) OVER w, 0) AS open
  FROM {name}_0 WHERE cap > 0 WINDOW w AS (PARTITION BY {over} ORDER BY cap / weight, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_2 AS (SELECT *, cap * open <= weight * greatest(total - used, 0) AS fits FROM {name}_1),
{name}_3 AS (SELECT *, sum(CASE WHEN fits THEN cap ELSE 0 END) OVER (PARTITION BY {over}) AS filled,
  sum(CASE WHEN fits THEN 0 ELSE weight END) OVER (PARTITION BY {over}) AS sharing FROM {name}_2),
{name}_b AS (SELECT {keys}, CASE WHEN fits THEN cap ELSE greatest((weight * (total - filled)) // nullif(sharing, 0), 0) END AS budget FROM {name}_3)"""


ORACLES["op4_mixing"] = f"""
WITH counted AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN source = 'src0' THEN 'crawl' WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') THEN 'books'
      WHEN source IN ('src10', 'src11', 'src12', 'src13', 'src14', 'src15', 'src16', 'src17', 'src18', 'src19') THEN 'forum' ELSE 'other' END AS domain,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS HUGEINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM counted GROUP BY ALL),
caps AS (SELECT *, tokens * 2 AS cap FROM leaves),
{_level("d", ["domain"], "CASE domain WHEN 'crawl' THEN 5 WHEN 'books' THEN 3 WHEN 'forum' THEN 2 ELSE 1 END", "(SELECT sum(tokens) FROM leaves)")},
{_level("l", ["domain", "lang"], "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END", "d_b")},
{_level("s", ["domain", "lang", "source"], "1", "l_b")},
need AS (SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS left_over FROM leaves JOIN s_b USING (domain, lang, source) WHERE tokens > 0),
run AS (SELECT doc_id, domain, lang, source, whole, left_over,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('7:', CAST(whole AS VARCHAR), ':', coalesce(CAST(doc_id AS VARCHAR), '')))
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM counted JOIN need USING (domain, lang, source)),
times AS (SELECT *, whole + CASE WHEN left_over > 0 AND upto <= left_over THEN 1 ELSE 0 END AS times FROM run)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch
FROM (SELECT *, unnest(range(CAST(times AS BIGINT))) AS epoch FROM times WHERE times > 0) t"""


@query
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every row whose vec_id is divisible by 50, by cosine, from all rows."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the quality rules: length, repetition, and the distance to their language."""
    found = rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Character classes in SQL; what is left over is the last class.
_CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "white": r" \t\x0b\f\r", "line": r"\n", "point": r"""\.,;:''"()\-""",
            "shout": "!\\?", "sign": r"#*$%&|<>", "wide": r"^\x00-\x7F"}


def _spread(p: str, q: str) -> str:
    """SQL of one bin of the Jensen-Shannon divergence of shares."""
    return (f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + "
            f"CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END")


_COUNTED = ", ".join(f"length(regexp_replace(t, '[{'' if c[0] == '^' else '^'}{c.lstrip('^')}]', '', 'g')) AS {k}" for k, c in _CLASSES.items())

ORACLES["op13_rules"] = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
words AS (SELECT rid, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs) x),
triples AS (SELECT *, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY rid ORDER BY pos)),
seen AS (SELECT rid, pos, word, CASE WHEN w3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY rid, word, w2, w3) END AS n FROM triples),
covered AS (SELECT rid, word, max(n) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 1 AS again FROM seen),
worded AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (again) AS n_repeat_words FROM covered GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (SELECT rid, doc_id, lang, t, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_words, 0) < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM docs LEFT JOIN worded USING (rid) LEFT JOIN dups USING (rid)),
classed AS (SELECT rid, lang, base_failed, n_words, length(t) AS n, {_COUNTED} FROM base),
bins AS (UNPIVOT (SELECT *, n - ({" + ".join(_CLASSES)}) AS rest FROM classed) ON {", ".join([*_CLASSES, "rest"])} INTO NAME class VALUE x),
class_ref AS (SELECT lang, class, sum(x) FILTER (NOT base_failed) AS y, sum(sum(x) FILTER (NOT base_failed)) OVER (PARTITION BY lang) AS total FROM bins GROUP BY lang, class),
char_far AS (SELECT rid, sqrt(greatest(sum({_spread("p", "q")}) / 2, 0)) AS far
  FROM (SELECT rid, CAST(x AS DOUBLE) / n AS p, CAST(y AS DOUBLE) / total AS q FROM bins JOIN class_ref USING (lang, class) WHERE n_words >= 100) z GROUP BY rid),
letters AS (SELECT rid, lang, base_failed, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+')) AS word FROM base),
totals AS (SELECT lang, count(*) AS total FROM letters WHERE NOT base_failed GROUP BY lang),
common AS (SELECT lang, word, count(*) AS y FROM letters WHERE NOT base_failed GROUP BY lang, word
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, encode(word)) <= 100),
word_ref AS (SELECT lang, word, y FROM common UNION ALL SELECT lang, NULL, any_value(total) - sum(y) FROM common JOIN totals USING (lang) GROUP BY lang),
doc_words AS (SELECT l.rid, l.lang, c.word, count(*) AS x FROM letters l LEFT JOIN common c ON l.lang = c.lang AND l.word = c.word GROUP BY ALL),
doc_totals AS (SELECT rid, lang, sum(x) AS n FROM doc_words GROUP BY rid, lang HAVING sum(x) >= 200),
word_far AS (SELECT rid, sqrt(greatest(sum({_spread("p", "q")}) / 2, 0)) AS far FROM (
    SELECT d.rid, coalesce(CAST(w.x AS DOUBLE), 0) / d.n AS p, CAST(r.y AS DOUBLE) / s.total AS q
    FROM doc_totals d JOIN word_ref r ON d.lang = r.lang JOIN totals s ON d.lang = s.lang
    LEFT JOIN doc_words w ON w.rid = d.rid AND w.word IS NOT DISTINCT FROM r.word) z GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
  OR (s.total >= 5000 AND (coalesce(c.far, 0) > 0.30 OR coalesce(w.far, 0) > 0.40)) IS TRUE) AS kept
FROM base b LEFT JOIN totals s ON b.lang = s.lang LEFT JOIN char_far c USING (rid) LEFT JOIN word_far w USING (rid)"""


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with 20 words or more, drawn towards the benchmark's words."""
    return resampling.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, least_words=20, percent=25, seed=7)


def _features(source: str, key: str) -> str:
    """SQL of all features (rid, f) of a table's texts."""
    return f"""SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {source}"""


def _split(source: str) -> str:
    return f"""SELECT row_number() OVER () AS rid, *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {source}"""


ORACLES["op12_resampling"] = f"""
WITH docs AS MATERIALIZED ({_split("documents")}), marks AS MATERIALIZED ({_split("benchmark")}),
doc_f AS MATERIALIZED ({_features("docs", "rid")}), mark_f AS MATERIALIZED ({_features("marks", "rid")}),
steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab
  FROM range(256) r(i)),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, octet_length(encode(f))),
      lambda p: CAST('0x' || substr(hex(encode(f)), 2 * p + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM (SELECT f FROM doc_f UNION ALL SELECT f FROM mark_f) x) y, steps),
s AS (SELECT bucket, count(*) AS s FROM doc_f JOIN hashed USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM mark_f JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM doc_f) + 10000) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM mark_f) + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT rid, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS BIGINT) / count(*)) AS BIGINT) AS weight FROM doc_f JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY rid),
scored AS (SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM docs LEFT JOIN weights USING (rid)),
ranked AS (SELECT *, n_words >= 20 AS fit, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS rank FROM ranked"""


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by a byte-level vocabulary and a sentence-piece model, aligned, with corpus-wide counts of their links."""
    import public_tokenizers

    return alignment.aligned_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
