"""Quality rules as a bitmask ledger: measure once, then apply policies and ablations to the stored bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table, words

#: Rules in bit order: name, condition of failure over the measurements. Bits never change their meaning; new rules go last.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    ("short_mean_word", "word_chars < 2 * n_words"),
    ("long_mean_word", "word_chars > 25 * n_words"),
    ("no_words", "n_words = 0"),
    ("long_text", "n_words > 100000"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the rules in force."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


#: The base policy and its successors.
POLICIES = {
    "base": Policy("base", ("too_few_words", "repeated_windows")),
    "v1": Policy("v1", ("too_few_words", "repeated_windows", "many_symbols", "duplicate_lines", "short_mean_word", "long_mean_word", "no_words")),
}


def _repeat_words(w: Column) -> Column:
    """Words that lie in a window of three words which occurs twice or more in the text."""
    n = F.size(w)
    windows = F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    return F.sort_array(windows)


def measure(docs: DataFrame) -> DataFrame:
    """Measurements of every row of ``docs(doc_id, text)``, all within the row: no shuffle.

    Null and empty texts measure 0 everywhere. Windows are compared by a 64-bit hash.
    """
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    step = step.select("doc_id", "_text", words(F.col("_text")).alias("_w"), lines.alias("_lines"))
    step = step.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("_s"),
    )
    # positions of windows equal to a neighbour in hash order, back in text order; each covers the words up to the next one, three at most
    twice = F.expr("filter(transform(_s, (x, k) -> if(x.h <=> get(_s, k - 1).h or x.h <=> get(_s, k + 1).h, x.i, null)), x -> x is not null)")
    step = step.withColumn("_p", F.sort_array(twice)).drop("_s")
    cover = F.expr("aggregate(_p, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p)).n")
    return step.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and failed_bits: every rule evaluated once. Bit k is rule k of RULES."""
    bits = sum((F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, cond) in enumerate(RULES)), F.lit(0))
    return measure(docs).withColumn("failed_bits", bits.cast("long"))


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """Adds kept: no rule of the policy failed. Reads bits only; texts are not measured again."""
    return book.withColumn("policy", F.lit(policy.version)).withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: rows it fails, rows only it fails (kept without it). One count per distinct bit pattern is
    shuffled, at most 2 ** len(RULES) of them."""
    counts = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules)))
    hit = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    return hit.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(ledger(table(spark, sf_dir, "documents")), POLICIES["v1"])
    failed = F.col("failed_bits").bitwiseAND(F.lit(POLICIES["base"].mask)) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "failed_bits")


WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP6_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, {WORDS_SQL} as w from documents),
win as (select rid, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 4),
win3 as (select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from win),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from win3) where n >= 2),
cov as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from rep) group by rid),
lines as (select rid, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines from (select rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d)),
m as (select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
  n_lines, n_dup_lines::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from d left join cov using (rid) join lines using (rid)),
b as (select *, case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end + case when n_symbols > n_words then 4 else 0 end
  + case when n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines then 8 else 0 end + case when word_chars < 2 * n_words then 16 else 0 end + case when word_chars > 25 * n_words then 32 else 0 end
  + case when n_words = 0 then 64 else 0 end + case when n_words > 100000 then 128 else 0 end as f from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f & 3) <> 0 as base_failed, (f & 127) = 0 as kept, f::bigint as failed_bits from b
"""
