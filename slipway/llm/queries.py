"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slipway.llm import (chat, decontaminate, exact, infill, jaccard, mixing, packing, passages, pii, spelling, suffixes,
                         templates, toxicity)
from slipway.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_exact_dedup", r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    docs = load(spark, sf_dir, "documents")
    return exact.with_digests(exact.exact_groups(docs), docs)


@query("op2_decontaminate", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, list_slice(w, s, s + 9) AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, s, n, item FROM dw JOIN bw USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items."""
    found = decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    scored = toxicity.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scored.select("doc_id", (~toxicity.learned()).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


#: Whole weights among siblings of the mixture; a name without a weight has 1.
MIXTURE = {"web": 3, "curated": 5, "web/en": 4, "web/de": 2, "web/fr": 2, "web/es": 1, "curated/en": 3,
           "curated/de": 2, "curated/fr": 2, "curated/es": 2, "web/en/src0": 2, "curated/en/src10": 4}


def domain() -> Column:
    """Sources src0 to src9 are web crawls, all others curated."""
    return F.when(F.col("source").rlike("^src[0-9]$"), F.lit("web")).otherwise(F.lit("curated"))


def _water_sql(name: str, nodes: str, parent: str, key: str) -> str:
    """One level of sharing as SQL; ``nodes`` has the path columns, cap, w and budget."""
    path = f"{parent}{', ' if parent else ''}budget"
    by = f"PARTITION BY {path} ORDER BY CASE WHEN w = 0 THEN NULL ELSE cap / w END NULLS LAST, {key}"
    return f"""
{name}_a AS (SELECT *, coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(w) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM ({nodes})),
{name}_b AS (SELECT *, cap::HUGEINT * w_left <= w::HUGEINT * (budget - used) AS is_full FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN is_full THEN 0 ELSE w END AS free FROM {name}_b),
{name}_d AS (SELECT *, greatest(0, budget - coalesce(sum(cap) FILTER (is_full) OVER (PARTITION BY {path}), 0)) AS rest,
    sum(free) OVER (PARTITION BY {path}) AS all_free, sum(free) OVER ({by} ROWS UNBOUNDED PRECEDING) AS cum FROM {name}_c),
{name} AS (SELECT * REPLACE ((CASE WHEN is_full THEN cap WHEN all_free = 0 THEN 0 ELSE
    (rest::HUGEINT * cum::HUGEINT) // all_free::HUGEINT - (rest::HUGEINT * (cum - free)::HUGEINT) // all_free::HUGEINT END)::BIGINT AS budget)
    FROM {name}_d)"""


def _weight_sql(path: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIXTURE.items())
    return f"CASE {path} {cases} ELSE 1 END"


MIX_SQL = rf"""
WITH r AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' ELSE 'curated' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
rows_ AS (SELECT * FROM r WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS available FROM rows_ GROUP BY ALL),
l2 AS (SELECT *, {_weight_sql("domain || '/' || lang || '/' || source")} AS w, available * 2 AS cap FROM leaves),
l1 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, {_weight_sql("domain || '/' || lang")} AS w FROM l2 GROUP BY 1, 2),
l0 AS (SELECT domain, sum(cap)::BIGINT AS cap, {_weight_sql("domain")} AS w FROM l1 GROUP BY 1),
{_water_sql("s0", "SELECT *, (SELECT (sum(available) * 50 // 100)::BIGINT FROM leaves) AS budget FROM l0", "", "domain")},
{_water_sql("s1", "SELECT l1.*, s0.budget FROM l1 JOIN s0 USING (domain)", "domain", "lang")},
{_water_sql("s2", "SELECT l2.*, s1.budget FROM l2 JOIN s1 USING (domain, lang)", "domain, lang", "source")},
o AS (SELECT rows_.*, budget // available AS whole, budget % available AS part,
    md5('1/' || (budget // available) || '/' || k) AS o FROM rows_ JOIN s2 USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT doc_id, domain, lang, source, n_tokens, whole + (CASE WHEN upto <= part THEN 1 ELSE 0 END) AS copies
FROM c WHERE whole + (CASE WHEN upto <= part THEN 1 ELSE 0 END) > 0"""


@query("op8_mix_sources", MIX_SQL)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, drawn to the mixture's weights."""
    return mixing.mix(load(spark, sf_dir, "documents"), domain(), MIXTURE)


@query("op6_ngram_jaccard")
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by shingle similarity of 0.8 or more."""
    return jaccard.jaccard_groups(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages of earlier documents."""
    found = suffixes.repeated_spans(load(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_line_templates")
def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs across documents."""
    found = templates.dropped_lines(load(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", F.size("dropped").cast("long").alias("n_dropped"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def _escaped_sql(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for x in chat.INSTRUCT.controls:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


def _turn_chars_sql() -> str:
    known = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b, _) in chat.INSTRUCT.roles.items())
    other = f"{sum(map(len, chat.INSTRUCT.other))} + length({_escaped_sql('role')})"
    return f"length({_escaped_sql('text')}) + CASE role {known} ELSE {other} END"


_TEST_CHAT = "</s>[INST] ok [/INST]"


@query("op5_chat_format", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_TEST_CHAT}' UNION ALL SELECT -7, 1, 'assistant', '{_TEST_CHAT}'),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({_turn_chars_sql()})::BIGINT AS formatted_chars FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars FROM g""")
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that consists of control strings, read back from their formatted text."""
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TEST_CHAT).alias("text"))
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_chats(turns).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn(
        "loss_text", chat.loss_text(F.col("segments")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.personal_data(load(spark, sf_dir, "documents")).withColumn(
        "known", F.filter("pii", lambda s: s["base"]))

    def count(kind: str) -> Column:
        return F.size(F.filter("known", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed(F.col("known")), 256).alias("base_sha256"),
                        pii.listed(F.col("pii")).alias("spans"))


@query("op7_near_passages")
def op7_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that an earlier document nearly holds."""
    docs = load(spark, sf_dir, "documents")
    found = passages.near_passages(docs)
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return docs.select("doc_id", F.xxhash64("text").alias("row")).join(
        found.withColumnRenamed("id", "doc_id"), ["doc_id", "row"], "left").select(
        "doc_id", F.coalesce(words, F.lit(0)).alias("n_words_repeated"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(listed, F.lit("")).alias("spans"))


@query("op11_harmonic_packing")
def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 4096 tokens."""
    import public_tokenizers

    found = packing.pieces(packing.packed(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                        "sequence_id", "offset")


def with_typos(runs: DataFrame, one_in: int = 199) -> DataFrame:
    """``runs`` (doc_id, run) with one code point left out of about one in ``one_in`` runs, chosen by checksum."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    return runs.select(F.when(h % one_in == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(
        "run", at + 2, F.length("run")))).otherwise(F.col("run")).alias("word"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, some of them damaged, with the form each one likely stands for."""
    runs = spelling.runs(load(spark, sf_dir, "documents"), keep=("doc_id",))
    words = with_typos(runs).filter(F.length("word") >= 6)
    return spelling.spelling_variants(spelling.vocabulary(words))


@query("op13_fill_in_middle", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
             CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
              WHEN 'spm' THEN '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a)
              ELSE '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) END)
         AS output_sha256, sha256(t) AS restored_sha256
FROM c""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for infilling, and the text rebuilt from that."""
    f = F.col("fim")
    return infill.fill_in_middle(load(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", f["n"].alias("n"), f["form"].alias("form"), f["prefix_chars"].alias("prefix_chars"),
        f["middle_chars"].alias("middle_chars"), F.sha2(f["output"], 256).alias("output_sha256"),
        F.sha2(infill.restored(f["output"], f["form"]), 256).alias("restored_sha256"))
