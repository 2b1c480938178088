"""The registered queries: each applies one operator to its whole table, and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import (decontaminate, fingerprint, hard_negatives, html_extract, language, line_dedup, merkle_manifest, near_dedup, packing, preference,
               quality, substring_dedup, url_filter)

VOCABULARY = "byte_bpe_50k"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(prepare(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_near_dedup")
def op1(spark, folder):
    return near_dedup.near_duplicates(table(spark, folder, "documents"), shingle=4, percent=80)


@query("op6_substring_dedup")
def op6(spark, folder):
    kept = substring_dedup.remove_repeats(table(spark, folder, "documents"), window=50)
    words = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce(words, F.lit("")), 256).alias("kept_sha256"))


@query("op10_decontaminate")
def op10(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def vocabulary() -> dict[str, str]:
    import public_tokenizers
    return {"vocabulary": public_tokenizers.path(f"{VOCABULARY}.json"), "ranks": public_tokenizers.path(f"{VOCABULARY}.tiktoken")}


@query("op2_best_fit_packing")
def op2(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), **vocabulary()).drop("row")


@query("op4_language_crf")
def op4(spark, folder):
    docs = table(spark, folder, "documents")
    model = language.learn(docs.filter(~language.held_out()))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op9_quality_network")
def op9(spark, folder):
    held_out = language.held_out(folds=5, fold=0)
    scored = quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels").filter(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_fingerprint")
def op3(spark, folder):
    return fingerprint.fingerprints(table(spark, folder, "documents"))


@query("op8_html_crf")
def op8(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.learn(pages))


URL_RULES = (url_filter.Rule("allow", "org"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
             url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/"))


@query("op7_url_filter")
def op7(spark, folder):
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url", "html"), URL_RULES)


def _preference_sql(levels: int) -> str:
    """The pairs of the first `levels` block sizes: enough for ids below 2 ** (10 * levels)."""
    step, rest, made = [], "whole", []
    for k in range(levels):
        step.append(f"""r{k} AS (SELECT conv_id, turns, row_number() OVER w AS n, lead(conv_id) OVER w AS partner FROM {rest}
            WINDOW w AS (PARTITION BY turns[1].role, turns[1].text, conv_id >> {10 * (k + 1)} ORDER BY conv_id)),
            l{k} AS (SELECT conv_id, turns FROM r{k} WHERE n % 2 = 1 AND partner IS NULL)""")
        made.append(f"SELECT conv_id AS a, partner AS b FROM r{k} WHERE n % 2 = 1 AND partner IS NOT NULL")
        rest = f"l{k}"
    said = "coalesce(list_sum(list_transform(list_filter({0}, lambda t: t.role = 'assistant'), lambda t: length(t.text))), 0)"
    head, body = "'<|im_start|>' || coalesce(t.role, '') || chr(10)", "coalesce(t.text, '') || '<|im_end|>'"
    text = f"array_to_string(list_transform({{0}}, lambda t: {head} || {body} || chr(10)), '')"
    trained = f"array_to_string(list_transform(list_filter({{0}}, lambda t: t.role = 'assistant'), lambda t: {body}), '')"
    return f"""WITH turn AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
        conv AS (SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM turn GROUP BY conv_id),
        whole AS (SELECT min(conv_id) AS conv_id, turns FROM conv GROUP BY turns), {", ".join(step)}, made AS ({" UNION ALL ".join(made)}),
        duo AS (SELECT a, b, x.turns AS ta, y.turns AS tb, {said.format("x.turns")} >= {said.format("y.turns")} AS a_first
            FROM made JOIN whole x ON x.conv_id = a JOIN whole y ON y.conv_id = b),
        answer AS (SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS k FROM whole),
        lent AS (SELECT *, coalesce(lead(conv_id) OVER v, first(conv_id) OVER v) AS next_id, if(lead(conv_id) OVER v IS NULL, first(turns[k].text) OVER v,
            lead(turns[k].text) OVER v) AS next_text FROM answer WHERE k IS NOT NULL WINDOW v AS (ORDER BY conv_id)),
        pair AS (SELECT if(a_first, a, b) AS chosen_id, if(a_first, ta, tb) AS c, if(a_first, b, a) AS rejected_id, if(a_first, tb, ta) AS r FROM duo
            UNION ALL SELECT conv_id, turns, next_id, list_concat(list_concat(turns[:k - 1], [{{'turn': turns[k].turn, 'role': turns[k].role, 'text': next_text}}]),
            turns[k + 1:]) FROM lent),
        cut AS (SELECT *, len(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: list_transform(c[1:i], lambda t: [t.role, t.text])
            IS NOT DISTINCT FROM list_transform(r[1:i], lambda t: [t.role, t.text]))) AS k FROM pair)
        SELECT chosen_id, rejected_id, k AS n_common, {text.format("c[1:k]")} AS prompt, {text.format("c[k + 1:]")} AS chosen,
            {text.format("r[k + 1:]")} AS rejected, {trained.format("c[k + 1:]")} AS chosen_trained, {trained.format("r[k + 1:]")} AS rejected_trained FROM cut"""


@query("op5_preference_pairs", _preference_sql(4))
def op5(spark, folder):
    whole = preference.distinct_conversations(table(spark, folder, "conversations"))
    formatted = preference.format_pairs(preference.pair_up(whole).union(preference.borrow_answers(whole)))
    whole = {c: F.array_join(F.transform(c, lambda s: s["text"]), "") for c in ("chosen", "rejected")}
    trained = {c: F.array_join(F.transform(F.filter(c, lambda s: s["trained"]), lambda s: s["text"]), "") for c in ("chosen", "rejected")}
    return formatted.select("chosen_id", "rejected_id", F.col("n_common").cast("bigint").alias("n_common"), "prompt", *[x.alias(c) for c, x in whole.items()],
                            *[x.alias(f"{c}_trained") for c, x in trained.items()])


_LINE_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_line_dedup", f"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    lined AS (SELECT r, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM doc), keyed AS (SELECT r, i, line, {_LINE_KEY} AS k FROM lined),
    often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
    kept AS (SELECT r, count(*) AS n_lines, count(often.k) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often.k IS NULL), '') AS text
        FROM keyed LEFT JOIN often ON keyed.k = often.k GROUP BY r)
    SELECT doc_id, n_lines, n_dropped, sha256(kept.text) AS kept_sha256 FROM kept JOIN doc USING (r)""")
def op11(spark, folder):
    kept = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), least=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _manifest_sql(levels: int) -> str:
    """Trees of up to 16 ** levels leaves, level by level; a tree of one node is carried up as it is."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    leaf = f"sha256({' || '.join(field.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', '{0}'))})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda c, b: {step}), 4294967295)"

    def grow(name: str, base: str, key: str) -> list[str]:
        made, now = [], base
        for k in range(levels):
            made.append(f"{name}r{k} AS (SELECT {key}, p // 16 AS p, list(h ORDER BY p) AS run, any_value(n) AS n FROM {now} GROUP BY ALL)")
            made.append(f"{name}{k} AS (SELECT {key}, p, if(n = 1, run[1], sha256(array_to_string(run, ''))) AS h, (n + 15) // 16 AS n FROM {name}r{k})")
            now = f"{name}{k}"
        return made

    def joins(name: str, key: str, at: str) -> str:
        return " ".join(f"JOIN {name}r{k} ON {name}r{k}.{key} = x.{key} AND {name}r{k}.p = x.{at} // {16 ** (k + 1)}" for k in range(levels))

    def sides(name: str, at: str, k: int) -> tuple[str, str]:
        place = f"(x.{at} // {16 ** k} % 16)"
        return f"array_to_string({name}r{k}.run[1:{place}], '')", f"array_to_string({name}r{k}.run[{place} + 2:], '')"

    def folded(start: str, name: str, at: str) -> str:
        for k in range(levels):
            a, b = sides(name, at, k)
            start = f"if({name}r{k}.n = 1, {start}, sha256({a} || {start} || {b}))"
        return start

    def siblings(name: str, at: str) -> str:
        return " || ".join(f"if({name}r{k}.n = 1, '', {' || '.join(sides(name, at, k))})" for k in range(levels))

    return f"""WITH raw AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, {leaf.format('text')} AS leaf,
            CASE WHEN {crc} % 5 = 0 THEN {leaf.format(f'({lower})')} END AS bad FROM documents),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM raw),
        base AS (SELECT tree, p, leaf AS h, n FROM leaves), {', '.join(grow('s', 'base', 'tree'))},
        tops AS (SELECT 0 AS g, tree, h, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM s{levels - 1}),
        tbase AS (SELECT g, p, h, n FROM tops), {', '.join(grow('t', 'tbase', 'g'))},
        high AS (SELECT x.tree, x.h AS subroot, x.p AS tp, x.g, {siblings('t', 'p')} AS above FROM tops x {joins('t', 'g', 'p')}),
        low AS (SELECT x.*, {siblings('s', 'p')} AS below, {folded("coalesce(x.bad, x.leaf)", 's', 'p')} AS part FROM leaves x {joins('s', 'tree', 'p')}),
        x AS (SELECT low.*, subroot, tp, g, sha256(below || above) AS proof_sha256 FROM low JOIN high USING (tree)),
        done AS (SELECT x.doc_id, x.leaf, x.subroot, x.proof_sha256, {folded('x.part', 't', 'tp')} AS folded_root FROM x {joins('t', 'g', 'tp')})
        SELECT doc_id, leaf, subroot, h AS root, proof_sha256, folded_root, folded_root = h AS verified FROM done, t{levels - 1}"""


@query("op12_merkle_manifest", _manifest_sql(5))
def op12(spark, folder):
    docs = table(spark, folder, "documents").select(*merkle_manifest.FIELDS)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle_manifest.audit(merkle_manifest.build(docs, altered=F.when(hit, lowered).otherwise(F.col("text"))))


@query("op13_hard_negatives", """WITH given AS (SELECT vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
        FROM given a JOIN given b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    positive AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id,
        positive_score, score AS negative_score FROM positive JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""")
def op13(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)
