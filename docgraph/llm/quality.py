"""Quality rules whose cutoffs are chosen under a bound on false rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, maybe_in, read, running

SYMBOLS = "#*$%&|<>"
ALPHA = 0.05  # of good documents, at most this share is rejected by all rules together, per stratum
DELTA = 0.05  # chance that any of the certified cutoffs breaks its bound
#: Rule -> cutoffs tried, strictest first. A document is rejected where its figure is above the cutoff.
RULES = {
    "symbol_share": (0.01, 0.02, 0.04, 0.08, 0.16, 0.32),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.6),
    "repeat_word_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.45),
    "shout_share": (0.02, 0.05, 0.1, 0.2, 0.4, 0.6),
    "mean_word_chars": (7.0, 8.0, 10.0, 12.0, 16.0, 24.0),
}


def _windows(words: Column) -> Column:
    """Hashes of the 3-word windows of a word array of 3 words or more, each word hashed once."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2])))


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window that the array holds twice or more.

    Most texts repeat no window, which their distinct hashes show. Else windows are sorted by hash, those equal to a
    neighbour keep their places, and the union of the places' spans of three words is measured in place order:
    everything is linear or sorting, within the row.
    """

    def spans(hashes: Column) -> Column:
        windows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(windows, lambda w: let(F.sort_array(F.transform(repeated(w), lambda x: x["i"])), covered))

    def repeated(windows: Column) -> Column:
        n = F.size(windows)
        return F.filter(windows, lambda w, k: ((k > 0) & (windows[F.greatest(k - 1, F.lit(0))]["h"] == w["h"])) | ((k + 1 < n) & (windows[F.least(k + 1, n - 1)]["h"] == w["h"])))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - places[F.greatest(k - 1, F.lit(0))]))), F.lit(0).cast("long"), lambda a, x: a + x)

    none = F.lit(0).cast("long")
    counted = let(_windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(spans(h)))
    return F.when(F.size(words) < 4, none).otherwise(counted)


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the contract and the rules' figures of each whole text; null counts as no text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # one pass of the regex machine turns every white space but \n into a blank, then splitting is by single characters
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    words = F.filter(F.split(F.translate(whole, "\t\n\u000b\f\r", "     "), " "), lambda x: x != "")
    out = docs.withColumns({"__lines": lines, "__words": words})
    count = lambda pattern: F.length(whole) - F.length(F.translate(whole, pattern, ""))
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate(whole, " \t\n\u000b\f\r", "")).cast("long"),
            "n_symbols": count(SYMBOLS).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__words")),
            "n_shouts": count("!").cast("long"),
        }
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_word_share": share("n_repeat_words", "n_words"),
            "shout_share": share("n_shouts", "n_words"),
            "mean_word_chars": share("word_chars", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    ).drop("__lines", "__words")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly by its terms, summed in logarithms so that large n do not underflow."""
    odds = F.log(F.lit(p / (1 - p)))
    begin = F.struct((n * F.log(F.lit(1 - p))).alias("term"), (n * F.log(F.lit(1 - p))).alias("total"))

    def step(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), begin, step, lambda acc: F.exp(acc["total"]))
    return F.when(k == 0, F.exp(n * F.log(F.lit(1 - p)))).otherwise(tail)


def certify(holdout: DataFrame, stratum: str, good: str, rules=None, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): for each, the strictest cutoff certified.

    For every stratum, rule and cutoff the false rejections k among the n good documents of the holdout test the
    hypothesis "more than alpha / (number of rules) of good documents are rejected" by the exact binomial tail
    P(X <= k).  Holm's step-down over all of them holds the chance of any false certificate to ``delta``; a union
    over the rules holds a stratum's false rejections to ``alpha``.  Rules without a certified cutoff stay off in
    that stratum.  Counting is one map-side combined aggregate; the tests are one row a hypothesis.
    """
    rules = rules or RULES
    each = alpha / len(rules)
    tries = [(r, c) for r, cs in rules.items() for c in cs]
    counts = [F.sum((F.col(r) > F.lit(float(c))).cast("long")).alias(f"k{i}") for i, (r, c) in enumerate(tries)]
    wide = holdout.where(F.col(good)).groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), *counts)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (r, c) in enumerate(tries)])
    tests = wide.select("stratum", "n", F.explode(rows).alias("t")).select("stratum", "n", "t.*")
    # above its mean the tail is no small one: no need to sum it
    tests = tests.withColumn("p", F.when(F.col("k") >= F.col("n") * each, F.lit(1.0)).otherwise(binomial_tail(F.col("k"), F.col("n"), each)))
    order = [F.col("p").asc(), F.col("stratum").asc_nulls_first(), F.col("rule").asc(), F.col("cutoff").desc()]
    ranked = cut(running(tests.withColumn("one", F.lit(1)), order, {"rank": "one"}), small=True)
    failed = ranked.where(F.col("p") > F.lit(delta) / (F.lit(ranked.count()) - F.col("rank"))).agg(F.min("rank")).head()[0]
    holm = ranked if failed is None else ranked.where(F.col("rank") < failed)
    return holm.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id") -> DataFrame:
    """``docs`` with counts, ``base_failed`` and ``kept``.

    ``labels`` (key, quality) gives the holdout: the cutoffs tried are fixed beforehand, so every labelled row counts
    and none is fitted to.  Documents that fail the base rules are out of the holdout, as they are rejected anyway.
    Null texts have no words and fail the base; a null stratum is a stratum; repeated rows are judged alike; without
    labels only the base rules reject.
    """
    narrow = cut(figures(docs.select(F.col(key).alias("__key"), F.col(stratum).alias("__stratum"), F.xxhash64("text").alias("__hash"), F.col("text")), "text").drop("text"))
    marks = labels.select(F.col(key).alias("__mark"), F.col("quality")).where("quality = 1").distinct()
    holdout = narrow.where("not base_failed").join(marks, F.col("__key") == F.col("__mark"), "left_semi").withColumn("__good", F.lit(True))
    found = certify(holdout, "__stratum", "__good")
    # one row a stratum, with a cutoff for every rule; infinite where none is certified
    cutoffs = found.groupBy(F.col("stratum").alias("__s")).agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__cut_{r}") for r in RULES])
    cutoffs = cut(cutoffs, small=True)
    small = cutoffs.limit(10_001).count() <= 10_000
    out = narrow.join(F.broadcast(cutoffs) if small else cutoffs, F.col("__stratum").eqNullSafe(F.col("__s")), "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"__cut_{r}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~over)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps; most of them never leave their task."""
    gone = cut(judge(docs, labels, stratum, key).where(~F.col("kept")).select("__key", "__hash").distinct())
    sure = maybe_in(docs, key, gone.select("__key"), anti=True)
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64("text") == F.col("__hash"))
    return sure.unionByName(maybe_in(docs, key, gone.select("__key")).join(gone, same, "left_anti"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = judge(docs, labels)
    return out.select(F.col("__key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_TRIES = ", ".join(f"('{r}', {c}::double)" for r, cs in RULES.items() for c in cs)
#: Rows of documents with counts and verdict; ``{documents}`` and ``{labels}`` are relations.
FIGURES_SQL = r"""
t as (select doc_id, lang, coalesce(text, '') as text, row_number() over () as rid from documents),
w as (select rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i from t),
g as (select rid, i, lead(word, 1) over v as w2, lead(word, 2) over v as w3, word from w window v as (partition by rid order by i)),
h as (select rid, i, count(*) over (partition by rid, word, w2, w3) as c from g where w3 is not null),
r as (select rid, count(distinct p)::bigint as n from (select rid, unnest([i, i + 1, i + 2]) as p from h where c > 1) group by rid),
l as (select rid, unnest(string_split(text, chr(10))) as line from t),
ld as (select rid, count(*)::bigint as n_lines, (count(*) - count(distinct line))::bigint as n_dup from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
f as (
  select t.rid, doc_id, lang,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    len(regexp_extract_all(text, '!'))::bigint as n_shouts,
    coalesce(n_lines, 0) as n_lines, coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from t left join r using (rid) left join ld using (rid)),
x as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    case when word_chars > 0 then n_symbols::double / word_chars else 0 end as symbol_share,
    case when n_lines > 0 then n_dup_lines::double / n_lines else 0 end as dup_line_share,
    case when n_words > 0 then n_repeat_words::double / n_words else 0 end as repeat_word_share,
    case when n_words > 0 then n_shouts::double / n_words else 0 end as shout_share,
    case when n_words > 0 then word_chars::double / n_words else 0 end as mean_word_chars
  from f)"""
VERDICT_SQL = rf"""
u as (unpivot (select rid, lang, symbol_share, dup_line_share, repeat_word_share, shout_share, mean_word_chars from x
               where not base_failed and doc_id in (select doc_id from labels where quality = 1))
      on symbol_share, dup_line_share, repeat_word_share, shout_share, mean_word_chars into name rule value v),
k as (select lang, u.rule, cutoff, count(*)::bigint as n, count(*) filter (v > cutoff)::bigint as k
      from u join (values {_TRIES}) c(rule, cutoff) on u.rule = c.rule group by all),
p as (select *, case when k >= n * {ALPHA / len(RULES)!r}::double then 1.0::double else list_sum(list_transform(range(k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - (case when i = n then 0 else lgamma(n - i + 1) end) + i * ln({ALPHA / len(RULES)!r}::double) + (n - i) * ln(1 - {ALPHA / len(RULES)!r}::double)))) end as p from k),
o as (select *, p <= {DELTA} / (count(*) over () - row_number() over v + 1) as ok from p window v as (order by p, lang nulls first, rule, cutoff desc)),
m as (select *, bool_and(ok) over (order by p, lang nulls first, rule, cutoff desc rows unbounded preceding) as upto from o),
q as (select lang, rule, min(cutoff) as cutoff from m where upto group by all),
bad as (select distinct x.rid from x join q on x.lang is not distinct from q.lang where
        case q.rule when 'symbol_share' then symbol_share when 'dup_line_share' then dup_line_share when 'repeat_word_share' then repeat_word_share
          when 'shout_share' then shout_share else mean_word_chars end > q.cutoff)"""
SQL = f"""
with {FIGURES_SQL}, {VERDICT_SQL}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and rid not in (select rid from bad) as kept
from x
"""
