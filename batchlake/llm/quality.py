"""Operator 7: a ledger of rule failures as bits, with policies and ablations on top.

Every rule is evaluated once for every document: the ledger keeps what was
measured and one bit for each rule that failed. A policy is a mask of rules that
reject; it is applied to the stored bits, so a new version needs no new pass
over the texts. Ablations count from the histogram of bitmasks alone. `too_long` is noted, but no
policy rejects a text for its length.

Cases: a null text is measured as an empty one (it fails `no_words`); ratios of
a text without words are 0; repeated rows and null doc_ids have ledger rows of
their own; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .durable import unpacked, whole_row

SPACE = r"[ \t\n\r\f]+"

#: name -> SQL condition on the measurements under which a document fails; the order gives the bit.
RULES: dict[str, str] = {
    "no_words": "n_words < 1",
    "too_long": "n_words > 1000000",
    "word_length": "n_words >= 50 and (mean_word < 2 or mean_word > 16)",
    "symbols": "n_words >= 5 and symbols > 0.3",
    "exclamations": "n_words >= 5 and exclamations > 0.3",
    "pipes": "n_words >= 5 and pipes > 0.15",
    "uppercase": "n_words >= 5 and uppercase > 0.6",
    "adjacent_repeats": "n_words >= 10 and repeats > 0.2",
    "few_letters": "n_words >= 20 and letters < 0.5",
    "duplicate_lines": "n_lines >= 8 and duplicate_lines > 0.6",
}
BIT = {name: k for k, name in enumerate(RULES)}

#: version -> rules that reject under it.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("no_words", "symbols", "exclamations", "pipes", "uppercase"),
    "v2": ("no_words", "word_length", "symbols", "exclamations", "pipes", "uppercase", "adjacent_repeats", "few_letters"),
    "v3": ("no_words", "word_length", "symbols", "exclamations", "pipes", "uppercase", "adjacent_repeats", "few_letters", "duplicate_lines"),
}
MEASURES = ("n_chars", "n_words", "n_lines", "mean_word", "symbols", "exclamations", "pipes", "uppercase", "repeats", "letters", "duplicate_lines")


def mask(policy: str) -> int:
    return sum(1 << BIT[r] for r in POLICIES[policy])


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*keep, t.alias("__t"))
    d = d.withColumns({"__w": F.filter(F.split("__t", SPACE), lambda x: x != ""), "__l": F.filter(F.split("__t", "\n"), lambda x: F.trim(x) != "")})
    # translate() keeps to one pass over the bytes where a pattern would be matched at every place
    d = d.withColumns({
        "n_chars": F.expr("cast(length(__t) as bigint)"),
        "n_words": F.expr("cast(size(__w) as bigint)"),
        "n_lines": F.expr("cast(size(__l) as bigint)"),
        "__space": F.length("__t") - F.length(F.translate("__t", " \t\n\r\f", "")),
        "__sym": F.expr("length(__t) - length(translate(__t, '#$%&*@^~<>{}=+', ''))"),
        "__bang": F.expr("(length(__t) - length(replace(__t, '!!', ''))) div 2"),
        "__pipe": F.expr("length(__t) - length(translate(__t, '|', ''))"),
        "__up": F.expr("length(__t) - length(translate(__t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))"),
        "__low": F.expr("length(__t) - length(translate(__t, 'abcdefghijklmnopqrstuvwxyz', ''))"),
        "__punct": F.expr(r"""length(__t) - length(translate(__t, '0123456789!"#$%&()*+,-./:;<=>?@[]^_{|}~', ''))"""),
        "__same": F.expr("size(filter(__w, (x, i) -> x = get(__w, i + 1)))"),
        "__dup": F.expr("size(__l) - size(array_distinct(__l))"),
    })
    words, chars = "greatest(n_words, 1)", "greatest(n_chars - __space, 1)"
    ratio = lambda a, b: F.expr(f"round(cast({a} as double) / {b}, 6)")
    return d.select(
        *keep, "n_chars", "n_words", "n_lines",
        ratio("(n_chars - __space)", words).alias("mean_word"), ratio("__sym", words).alias("symbols"), ratio("__bang", words).alias("exclamations"),
        ratio("__pipe", words).alias("pipes"), ratio("__up", "greatest(__up + __low, 1)").alias("uppercase"), ratio("__same", words).alias("repeats"),
        ratio("(n_chars - __space - __punct)", chars).alias("letters"), ratio("__dup", "greatest(n_lines, 1)").alias("duplicate_lines"),
    )


def _bits_sql() -> str:
    return " + ".join(f"case when {c} then {1 << k} else 0 end" for k, c in enumerate(RULES.values()))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, fail_bits, and keep_<version> for each policy), one row for each row of docs."""
    d = _measured(docs, "doc_id").withColumn("fail_bits", F.expr(f"cast({_bits_sql()} as bigint)"))
    return d.withColumns({f"keep_{v}": F.expr(f"fail_bits & {mask(v)} = 0") for v in POLICIES})


def ablation(led: DataFrame) -> DataFrame:
    """(policy, rule, used, failed, only_this, kept, kept_without, kept_with) from a ledger's bits, for every rule and every policy.

    failed: documents with the rule's bit; only_this: those that the policy rejects for
    this rule alone; kept: by the policy; kept_without: by the policy less the rule;
    kept_with: by the policy with the rule, be it in it (`used`) or not.
    """
    h = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rows = [(v, r, r in POLICIES[v], 1 << BIT[r], mask(v)) for v in POLICIES for r in RULES]
    rules = F.explode(F.array(*(F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(u).alias("used"), F.lit(b).cast("long").alias("bit"), F.lit(m).cast("long").alias("mask")) for v, r, u, b, m in rows)))
    x = h.withColumn("r", rules).select("fail_bits", "n", "r.*")
    total = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0)).cast("long")
    return x.groupBy("policy", "rule", "used").agg(
        total("fail_bits & bit <> 0").alias("failed"), total("fail_bits & mask = bit").alias("only_this"), total("fail_bits & mask = 0").alias("kept"),
        total("fail_bits & (mask & ~bit) = 0").alias("kept_without"), total("fail_bits & (mask | bit) = 0").alias("kept_with"),
    )


def keep_good(docs: DataFrame, policy: str = "v3") -> DataFrame:
    """The rows of docs that the policy accepts, with the columns of docs, whatever their names.

    The ledger's bits decide: null, empty and blank texts go (`no_words`), repeated
    rows stay as often as they are there, an empty table gives no rows.
    """
    tagged = docs.select(whole_row(docs).alias("__row"), F.col("text"))
    # the filter stays above a projection that is not deterministic; pushed down, it would split the text anew for every rule
    d = _measured(tagged, "__row").select("__row", F.expr(_bits_sql()).alias("__bits"), F.monotonically_increasing_id().alias("__stay"))
    return unpacked(d.filter(F.expr(f"__bits & {mask(policy)} = 0 and __stay >= 0")), "__row", docs.columns)


_DUCK_LEDGER = rf"""
with t as (select doc_id, coalesce(text, '') t from documents),
a as (select doc_id, t, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') w,
             list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') l from t),
b as (select doc_id, length(t)::BIGINT n_chars, len(w)::BIGINT n_words, len(l)::BIGINT n_lines,
  length(t) - length(regexp_replace(t, '[ \t\n\r\f]', '', 'g')) sp,
  length(t) - length(regexp_replace(t, '[#$%&*@^~<>{{}}=+]', '', 'g')) sym,
  (length(t) - length(replace(t, '!!', ''))) // 2 bang,
  length(t) - length(replace(t, '|', '')) pipe,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) up,
  length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) low,
  length(t) - length(regexp_replace(t, '[0-9!"#$%&()*+,\-./:;<=>?@\[\]^_{{|}}~]', '', 'g')) punct,
  len(list_filter(list_zip(w, w[2:]), lambda x: x[1] = x[2])) same,
  len(l) - len(list_distinct(l)) dup from a),
c as (select doc_id, n_chars, n_words, n_lines,
  round((n_chars - sp)::DOUBLE / greatest(n_words, 1), 6) mean_word, round(sym::DOUBLE / greatest(n_words, 1), 6) symbols,
  round(bang::DOUBLE / greatest(n_words, 1), 6) exclamations, round(pipe::DOUBLE / greatest(n_words, 1), 6) pipes,
  round(up::DOUBLE / greatest(up + low, 1), 6) uppercase, round(same::DOUBLE / greatest(n_words, 1), 6) repeats,
  round((n_chars - sp - punct)::DOUBLE / greatest(n_chars - sp, 1), 6) letters, round(dup::DOUBLE / greatest(n_lines, 1), 6) duplicate_lines from b),
led as (select *, ({_bits_sql()})::BIGINT fail_bits from c)
"""
LEDGER_SQL = _DUCK_LEDGER + "select *, " + ", ".join(f"fail_bits & {mask(v)} = 0 as keep_{v}" for v in POLICIES) + " from led"
ABLATION_SQL = (
    _DUCK_LEDGER
    + ", r(policy, rule, used, bit, mask) as (values "
    + ", ".join(f"('{v}', '{r}', {r in POLICIES[v]}, {1 << BIT[r]}, {mask(v)})" for v in POLICIES for r in RULES)
    + """)
select policy, rule, used, count(*) filter (fail_bits & bit <> 0) failed, count(*) filter (fail_bits & mask = bit) only_this, count(*) filter (fail_bits & mask = 0) kept,
  count(*) filter (fail_bits & mask & ~bit = 0) kept_without, count(*) filter (fail_bits & (mask | bit) = 0) kept_with
from led cross join r group by policy, rule, used"""
)
