"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lookup, boosted_trees, hard_negatives, jaccard_join, license_scan, packing, personal_data, ppm, prefix_bpe, prefix_trie, quality_rules, range_coder, url_filter
from .common import crc_of_id

URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(*columns) if columns else docs


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_docs(spark, sf_dir, "doc_id", "text"), crc_of_id() % 7 != 2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_docs(spark, sf_dir, "doc_id", "text"))


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op4_bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bloom_lookup.fingerprint_versions(_docs(spark, sf_dir, "doc_id", "text"))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op6_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = range_coder.write_files(_docs(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return range_coder.read_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = prefix_bpe.encode_documents(_docs(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.PATTERN)
    both = prefix_bpe.decode_documents(ids, path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "text")
    forest = boosted_trees.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_of_id() % 5 != 0)
    return boosted_trees.classify(docs, forest).select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", "predicted")


def op9_count_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_docs(spark, sf_dir, "doc_id", "text"))


def op10_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(_docs(spark, sf_dir, "doc_id", "text", "lang"), keep=["doc_id"]).drop("char_distance", "word_distance")


def op11_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_data.scan(_docs(spark, sf_dir, "doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    named = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in personal_data.KINDS]
    return spans.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named("spans").alias("spans"))


def op12_pca_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    return prefix_trie.rollup(*prefix_trie.branched(turns, F.col("conv_id") - F.col("conv_id") % 100, shared)).drop("a", "b")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ppm_score": op1_ppm_score,
    "op2_license_scan": op2_license_scan,
    "op3_best_two_fit": op3_best_two_fit,
    "op4_bloom_lookup": op4_bloom_lookup,
    "op5_redirect_equivalence": op5_redirect_equivalence,
    "op6_range_coder": op6_range_coder,
    "op7_prefix_bpe": op7_prefix_bpe,
    "op8_boosted_trees": op8_boosted_trees,
    "op9_count_rtree_join": op9_count_rtree_join,
    "op10_divergence": op10_divergence,
    "op11_weak_supervision": op11_weak_supervision,
    "op12_pca_rotation": op12_pca_rotation,
    "op13_prefix_trie": op13_prefix_trie,
}


def _url_sql() -> str:
    """The URL filter in DuckDB SQL: a recursive walk over the edges stands for the components."""

    def host(url: str) -> str:
        return f"translate(coalesce(regexp_extract({url}, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def path(url: str) -> str:
        return f"coalesce(regexp_extract({url}, '://([^/?#]*)([^?#]*)', 2), '')"

    def address(url: str) -> str:
        query = f"regexp_extract({url}, '://[^?#]*(\\?[^#]*)', 1)"
        for name in url_filter.TRACKING * 2:
            query = f"regexp_replace({query}, '(?i)([?&]){name}=[^&]*(&|$)', '\\1', 'g')"
        return f"CASE WHEN {host(url)} <> '' THEN {host(url)} || regexp_replace({path(url)}, '/$', '') || regexp_replace({query}, '[?&]$', '') END"

    def rule(url: str, what: str) -> str:
        cases = [f"WHEN ({host(url)} = '{r.host}' OR ends_with({host(url)}, '.{r.host}')) AND starts_with({path(url)}, '{r.path}') THEN '{getattr(r, what)}'" for r in sorted(URL_RULES, key=lambda r: -len(r.name))]
        return "CASE " + " ".join(cases) + " END"

    def resolved(rows: str, target: str, base: str, out: str) -> str:
        """The rows with the address that ``target`` names on a page at ``base``."""
        origin = lambda u: f"regexp_extract({u}, '^([^:]*://[^/?#]*)', 1)"
        folder = f"regexp_extract({path(base)}, '(?s)^(.*/)', 1)"
        whole = f"""CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {target} WHEN starts_with({target}, '//') THEN 'http:' || {target} WHEN starts_with({target}, '/') THEN {origin(base)} || {target}
          WHEN starts_with({target}, '?') THEN {origin(base)} || {path(base)} || {target} WHEN starts_with({target}, '#') THEN regexp_replace({base}, '(?s)#.*', '') || {target}
          ELSE {origin(base)} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {target} END"""
        step = "CASE WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN x = '.' THEN done ELSE done || '/' || x END"
        walked = f"list_reduce(list_prepend('', string_split({path('whole_')}, '/')[2:]), lambda done, x: {step})"
        plain = f"""{origin('whole_')} || CASE WHEN walked_ = '' THEN '/' ELSE walked_ END || CASE WHEN walked_ <> '' AND regexp_matches({path('whole_')}, '/\\.\\.?$') THEN '/' ELSE '' END
          || regexp_extract(whole_, '(?s)://[^?#]*([?#].*)$', 1)"""
        return f"""(SELECT * EXCLUDE (whole_, walked_), CASE WHEN contains({path('whole_')}, '/.') THEN {plain} ELSE whole_ END AS {out} FROM (SELECT *, {walked} AS walked_ FROM (SELECT *, {whole} AS whole_ FROM {rows})))"""

    links = []
    for tag, find in (("link\\b[^>]*\\brel\\s*=\\s*[\"'']?canonical\\b", "href\\s*="), ("meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b", "url\\s*=")):
        links.append(f"list_transform(regexp_extract_all(html, '(?is)<{tag}[^>]*>'), lambda tag: regexp_extract(tag, '(?is)\\b{find}\\s*[\"'']?([^\"''\\s>]+)', 1))")
    def decoded(target: str) -> str:
        for pattern, char in url_filter.REFERENCES:
            target = f"regexp_replace({target}, '{pattern}', '{char.replace(chr(39), chr(39) * 2)}', 'g')"
        return target

    seen = f"regexp_replace(html, '{url_filter.UNSEEN}', '', 'g')"
    given = "regexp_extract(html, '(?is)<base\\b[^>]*?\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)"
    pages = f"(SELECT url, {decoded(given)} AS given, list_transform(list_filter(list_concat({links[0]}, {links[1]}), lambda t: t <> ''), lambda t: {decoded('t')}) AS found FROM (SELECT url, {seen} AS html FROM pages))"
    based = f"(SELECT url, unnest(found) AS t, CASE WHEN given = '' THEN url ELSE own END AS base FROM {resolved(pages, 'given', 'url', 'own')})"
    return f"""WITH RECURSIVE l AS (SELECT url, whole AS t FROM {resolved(based, 't', 'base', 'whole')}),
e AS (SELECT {address("url")} AS a, {address("t")} AS b, t FROM l), g AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
walk AS (SELECT a AS node, a AS seen FROM g UNION SELECT node, b FROM walk JOIN g ON seen = a), comp AS (SELECT node, min(seen) AS component FROM walk GROUP BY 1),
own AS (SELECT page_id, {host("url")} AS host, {path("url")} AS path, {rule("url", "name")} AS rule, {rule("url", "verdict")} AS own, {address("url")} AS address FROM pages),
bad AS (SELECT DISTINCT coalesce(component, address) AS component FROM (SELECT address, own FROM own UNION ALL SELECT b, {rule("t", "verdict")} FROM e WHERE a <> b) LEFT JOIN comp ON node = address WHERE own = 'block')
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN coalesce(component, address) IN (SELECT component FROM bad WHERE component IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(component, address) AS component
FROM own LEFT JOIN comp ON node = address"""


def _rules_sql() -> str:
    """The quality rules in DuckDB SQL, for documents in one of the configured languages."""
    q, limits = quality_rules, quality_rules.Limits()
    white = "[\\x20\\x09-\\x0D]"
    classes = ["[a-z]+", f"{white}+", "[A-Z]+", "[0-9]+", "[^\\x00-\\x7F]+", "[.,;:''\"?()\\-]+"]
    steps, left = [], "t0"
    for k, pattern in enumerate(classes):
        steps.append(f"s{k + 1} AS (SELECT *, regexp_replace(t{k}, '{pattern}', '', 'g') AS t{k + 1} FROM s{k})")
        left = f"t{k + 1}"
    chars = ", ".join(f"length(t{k}) - length(t{k + 1})" for k in range(len(classes)) if k != q.DIGITS) + f", length({left})"
    every = max(len(v.split()) for v in limits.languages.values())
    common = "CASE lang " + " ".join(
        f"WHEN '{k}' THEN [" + ", ".join(f"len(list_filter(toks, lambda x: x = '{w}'))" for w in v.split()) + "]" for k, v in limits.languages.items()
    ) + " END"
    ref_c = ", ".join(f"sum(chars[{k + 1}])::DOUBLE" for k in range(len(classes)))
    ref_w = ", ".join(f"coalesce(sum(common[{k + 1}]), 0)::DOUBLE" for k in range(every))

    def distance(p: str, r: str) -> str:
        terms = f"[CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END for z in [[x.a, x.b] for x in list_transform(list_zip({p}, {r}), lambda y: {{'a': y[1]::DOUBLE / list_sum({p}), 'b': y[2] / list_sum({r})}})]]"
        return f"CASE WHEN list_sum({p}) > 0 THEN sqrt(greatest(list_sum({terms}) / 2, 0)) END"

    return f"""WITH s0 AS (SELECT doc_id, lang, coalesce(text, '') AS t0, list_filter(string_split_regex(coalesce(text, ''), '{white}+'), lambda x: x <> '') AS words,
  string_split_regex(lower(coalesce(text, '')), '[.,;:!?]*{white}+') AS toks, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{white}+', '', 'g') <> '') AS lines FROM documents),
{", ".join(steps)},
h AS (SELECT *, [{chars}] AS chars, {common} AS common, len(words) AS n_words, length(t0) - (length(t1) - length(t2)) AS word_chars, length(t0) - length(regexp_replace(t0, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM s{len(classes)}),
r AS (SELECT lang, [{ref_c}] AS rc, [{ref_w}] AS rw, sum(len(toks))::DOUBLE AS n FROM h GROUP BY lang),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram FROM s0, unnest(range(1, len(words) - 3)) u(i)),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY 1),
m AS (SELECT h.*, coalesce(n_repeat_words, 0) AS n_repeat_words, CASE WHEN list_sum(chars) >= {limits.least_chars} THEN {distance("chars", "rc")} END AS cd,
  CASE WHEN n_words >= {limits.least_words} THEN {distance("list_append(common, len(toks) - list_sum(common))", "list_append(rw[1:len(common)], n - list_sum(rw[1:len(common)]))")} END AS wd FROM h LEFT JOIN r USING (lang) LEFT JOIN rep USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(cd <= {limits.char_distance}, true) AND coalesce(wd <= {limits.word_distance} + {limits.word_scatter} / sqrt(n_words), true) AS kept FROM m"""


def _trie_sql() -> str:
    """The prefix trie in DuckDB SQL: a node's smallest member leads to all its ancestors, so nothing walks the tree."""
    step = "list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(acc, b))"
    crc = f"xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)), lambda acc, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"
    return f"""WITH t AS (SELECT conv_id, md5(length(r) || ':' || r || x) AS said, length(x) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(length(r) || ':' || r || x)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT h.*, least(h, coalesce(base_n, 0)) AS k FROM h LEFT JOIN (SELECT conv_id AS base, count(*) AS base_n FROM t GROUP BY 1) USING (base)),
r AS (SELECT n.conv_id, pos AS depth, said, chars FROM n JOIN t ON t.conv_id = base AND pos <= h UNION ALL SELECT conv_id, pos - h + k, said, chars FROM n JOIN t USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, depth, chars, md5(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM r),
m AS (SELECT conv_id, depth, chars, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS up, ended FROM p
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL, conv_id NOT IN (SELECT conv_id FROM p) FROM n),
g AS (SELECT depth, node, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
c AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY 1, 2),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * chars AS saved FROM g LEFT JOIN c USING (node, depth)),
s AS (SELECT m.depth, m.node, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM v JOIN m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY 1, 2)
SELECT v.conv_id, v.depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (depth, node) LEFT JOIN v q ON q.node = v.up AND q.depth = v.depth - 1"""


def _negatives_sql() -> str:
    """Hard negatives in DuckDB SQL: every anchor against all rows. Sums of integers below 2^53 are exact as doubles."""
    return """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score >= 30 * positive_score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""


ORACLES: dict[str, str] = {"op12_pca_rotation": _negatives_sql(), "op13_prefix_trie": _trie_sql(), "op5_redirect_equivalence": _url_sql(), "op10_divergence": _rules_sql()}
