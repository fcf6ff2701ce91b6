"""Quality rules by weak supervision.

Eight rules look at a document and vote good (+1), bad (-1) or abstain (0).
Expectation-maximisation over the observed vote patterns estimates how often
each rule is right on good and on bad documents, without labels; the verdict
is the posterior probability of "good", so one dissenting rule need not
reject a document and several weak ones can.

Everything is a DataFrame expression. A document is reduced to a vote pattern
(at most 3**8 = 6561 values), the patterns are counted with map-side partial
sums, and expectation-maximisation is one ``aggregate`` over the counted
patterns in a single row: its size is bounded by the number of patterns, not
by the corpus. The posterior goes back to the documents through a broadcast
join on the pattern, bounded by the same 6561 rows.

Null text counts as no words. A document without words gets all counts zero
and fails the base rule. Repeated rows are judged alike, every row is kept in
the result. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.llm.common import SPACE_CLASS, SPACES, WORD, or_empty, packed, table, unpacked
from cinderwell.session import written_table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = r"[#*$%&|<>]"
#: the fit ends when no posterior moves by more; not to get there is an error
TOLERANCE = 1e-9
MAX_STEPS = 20_000
THRESHOLD = 0.5
#: share of the good documents that a rule is taken to object to by mistake
RULE_ERROR = 0.002
#: (good votes, bad votes) that a rule is taken to have cast on documents of a
#: defect that is not its own before it sees any
PRIOR_OTHER = (4.5, 1.0)
#: what one of these counts, and one document in each class, is of the corpus
PSEUDO = 1e-4

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_ended_lines", "n_upper", "n_stutters"]


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _rule(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> list[tuple[str, Column]]:
    """(name, vote) of each rule, over the feature columns. A rule that only
    looks for a defect abstains where it finds none."""
    n = F.col("n_words")
    some = n > 0
    mean_length = _share("word_chars", "n_words")
    return [
        ("length", _rule(n < MIN_WORDS, n >= 50)),
        ("symbols", _rule(_share("n_symbols", "n_words") > 0.1, F.lit(False))),
        ("repeats", _rule(_share("n_repeat_words", "n_words") > 0.2, F.lit(False))),
        ("dup_lines", _rule(_share("n_dup_lines", "n_lines") > 0.3, F.lit(False))),
        ("stutter", _rule(_share("n_stutters", "n_words") > 0.2, F.lit(False))),
        ("word_length", _rule(some & ~mean_length.between(2.5, 12), mean_length.between(3.5, 8))),
        ("line_ends", _rule(some & (_share("n_ended_lines", "n_lines") < 0.3), some & (_share("n_ended_lines", "n_lines") >= 0.7))),
        ("capitals", _rule(_share("n_upper", "word_chars") > 0.3, F.lit(False))),
    ]


RULE_NAMES = ("length", "symbols", "repeats", "dup_lines", "stutter", "word_length", "line_ends", "capitals")
N_RULES = len(RULE_NAMES)
#: rules that only look for a defect
ONE_SIDED = {"symbols", "repeats", "dup_lines", "stutter", "capitals"}


def with_features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of the input, all by default) and the
    feature columns. Whole texts, one narrow pass, no shuffle.

    Windows are first compared by hash, which can miss no repetition; only a
    text in which two hashes agree has its windows compared as strings, so a
    hash collision cannot change a count.
    """
    t = F.col("t")
    out = packed(docs, or_empty(docs[f"`{text}`"]).alias("t"), keep=keep)
    out = out.select(
        "row", "t",
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: F.rtrim(F.translate(x, SPACES, " ")) != "").alias("lines"))
    out = out.select(
        "row", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?…。]" + SPACE_CLASS + r"*\z"))).cast("long").alias("n_ended_lines"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    done = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_ended_lines", "n_upper"]
    long_enough = F.col("n_words") >= WINDOW
    starts = F.sequence(F.lit(0), F.size("w") - WINDOW)
    at = lambda i: F.xxhash64(*[F.get("wh", i + k) for k in range(WINDOW)])
    out = out.select(
        *done, "w",
        F.when(F.col("n_words") > 1, F.size(F.filter(
            F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.get("wh", i) == F.get("wh", i - 1)))).otherwise(0)
        .cast("long").alias("n_stutters"),
        F.when(long_enough, F.transform(starts, at)).alias("grams"))
    done.append("n_stutters")
    suspect = F.size(F.array_distinct("grams")) < F.size("grams")
    out = out.select(*done, F.when(suspect, F.array_sort(F.transform(
        F.sequence(F.lit(0), F.size("w") - WINDOW),
        lambda i: F.struct(F.array_join(F.slice("w", i + 1, WINDOW), " ").alias("g"), i.alias("i"))))).alias("s"))
    like = lambda k, other: F.coalesce(F.get("s", k)["g"] == F.get("s", other)["g"], F.lit(False))
    twice = lambda k: like(k, k - 1) | like(k, k + 1)
    out = out.select(*done, F.when(F.col("s").isNotNull(), F.array_sort(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("s") - 1), twice), lambda k: F.get("s", k)["i"]))).alias("p"))
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("p") - 1), F.lit(0),
        lambda acc, k: acc + F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - F.get("p", k), F.lit(WINDOW))))
    return out.select(*done, F.when(F.size("p") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vote_pattern() -> Column:
    """The votes as one base-3 number, first rule in the lowest place."""
    return reduce(lambda a, b: a + b, [(vote + 1) * F.lit(3 ** j) for j, (_, vote) in enumerate(rules())]).cast("int")


def posteriors(patterns: DataFrame) -> DataFrame:
    """(pattern, n) -> (pattern, posterior): expectation-maximisation.

    The latent class is "good" or one defect for each rule, so that rules which
    object to the same documents do not outvote a rule with a defect of its
    own. A document has a defect only if the rule for it objects, so one to
    which no rule objects is good. In each class, each rule that votes objects
    at an unknown rate, independently of the other rules. Where a rule abstains
    it says nothing and is left out of the likelihood; a rule that only looks
    for a defect and finds none has voted. A rule that votes both ways and objects
    to most of what it votes on does not fit the corpus (line ends in a script
    without full stops) and is taken to abstain. The first guess is the strict one:
    good if no rule objects, else shared by the defects objected to. The state
    is one struct: log weight of each class, log rates of the two votes by
    class and rule, and for each pattern the class probabilities. Odd steps
    estimate weights and rates from the probabilities, even steps the reverse,
    until no posterior moves by more than TOLERANCE; the steps left of the fold
    then hand the state on.

    Counts are shares of the corpus, pseudo-counts too, so that the same shares
    of patterns give the same posteriors at any size. Pseudo-counts make a rule
    that never votes harmless. Good documents are objected to at the fixed rate
    RULE_ERROR, others at this rate at least: were it estimated, a frequent lone
    objection could be taken for a habit of good documents.
    """
    classes, rule_ids = (F.sequence(F.lit(0), F.lit(k)) for k in (N_RULES, N_RULES - 1))
    one_sided = F.array(*[F.lit(name in ONE_SIDED) for name, _ in rules()])
    vote_at = lambda v, j: F.when((v == 1) | ((v == 0) & F.get(one_sided, j)), 0).when(v == -1, 1).otherwise(2)  # noqa: E731  place in a rate pair
    votes = F.transform(rule_ids, lambda j: vote_at(F.floor(F.col("pattern") / F.pow(F.lit(3.0), j)) % 3 - 1, j))
    one = patterns.select("pattern", F.col("n").cast("double").alias("n"), votes.alias("v")) \
        .groupBy().agg(F.array_sort(F.collect_list(F.struct("pattern", "n", "v"))).alias("all"), F.sum("n").alias("size"))
    one = one.select(F.transform("all", lambda p: F.struct(p["pattern"].alias("pattern"), (p["n"] / F.col("size")).alias("n"), p["v"].alias("v"))).alias("all"))

    def total(items: Column, f) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda a, x: a + f(x))

    of = lambda j, vote: total(F.col("all"), lambda p: F.when(F.get(p["v"], j) == vote, p["n"]).otherwise(0.0))
    one = one.select("all", F.transform(rule_ids, lambda j: ~F.get(one_sided, j) & (of(j, 1) > of(j, 0))).alias("off"))
    one = one.select(F.transform("all", lambda p: F.struct(p["pattern"].alias("pattern"), p["n"].alias("n"), F.transform(
        p["v"], lambda x, j: F.when(F.get(F.col("off"), j), 2).otherwise(x)).alias("v"))).alias("all"))

    def first(p: Column) -> Column:
        objections = total(p["v"], lambda x: F.when(x == 1, 1.0).otherwise(0.0))
        share = F.transform(classes, lambda c: F.when(objections == 0, F.when(c == 0, 1.0).otherwise(0.0))
                            .when(c == 0, 0.1).otherwise(F.when(F.get(p["v"], c - 1) == 1, 0.9).otherwise(0.0) / objections))
        return F.struct(p["n"].alias("n"), p["v"].alias("v"), share.alias("g"), F.lit(1.0).alias("moved"))

    def estimate(state: Column) -> Column:
        post = state["post"]
        weight = F.transform(classes, lambda c: F.log((total(post, lambda p: p["n"] * F.get(p["g"], c)) + PSEUDO) / (1.0 + (N_RULES + 1) * PSEUDO)))
        rate = F.transform(classes, lambda c: F.transform(rule_ids, lambda j: F.transform(
            F.sequence(F.lit(0), F.lit(1)), lambda vote: total(post, lambda p: F.when(
                F.get(p["v"], j) == vote, p["n"] * F.get(p["g"], c)).otherwise(0.0))
            + PSEUDO * F.when(vote == 1, PRIOR_OTHER[1]).otherwise(PRIOR_OTHER[0]))))
        # counts of the two votes to log rates; of its own defect a rule says nothing but that
        rate = F.transform(rate, lambda by_rule, c: F.transform(by_rule, lambda by_vote, j: F.when(c == j + 1, F.array(F.lit(0.0), F.lit(0.0))).otherwise(
            F.transform(by_vote, lambda x, vote: F.log(
                F.when(c == 0, F.when(vote == 1, RULE_ERROR).otherwise(1.0 - RULE_ERROR))
                .otherwise(F.least(F.greatest(x / (F.get(by_vote, F.lit(0)) + F.get(by_vote, F.lit(1))), F.lit(RULE_ERROR)), F.lit(1.0 - RULE_ERROR))))))))
        return F.struct(weight.alias("weight"), rate.alias("rate"), post.alias("post"))

    def expect(state: Column) -> Column:
        def share(p: Column) -> Column:
            likely = F.transform(classes, lambda c: F.when((c > 0) & (F.get(p["v"], c - 1) != 1), 0.0).otherwise(F.exp(
                F.get(state["weight"], c) + total(rule_ids, lambda j: F.coalesce(
                    F.get(F.get(F.get(state["rate"], c), j), F.get(p["v"], j)), F.lit(0.0))))))
            g = F.get(F.transform(F.array(likely), lambda e: F.transform(e, lambda x: x / total(e, lambda y: y))), F.lit(0))
            before = F.get(p["g"], F.lit(0))
            return F.get(F.transform(F.array(g), lambda x: F.struct(
                p["n"].alias("n"), p["v"].alias("v"), x.alias("g"), F.abs(F.get(x, F.lit(0)) - before).alias("moved"))), F.lit(0))

        return F.struct(state["weight"].alias("weight"), state["rate"].alias("rate"),
                        F.transform(state["post"], share).alias("post"))

    start = F.struct(F.expr("cast(array() as array<double>)").alias("weight"),
                     F.expr("cast(array() as array<array<array<double>>>)").alias("rate"),
                     F.transform("all", first).alias("post"))
    moving = lambda state: F.exists(state["post"], lambda p: p["moved"] > TOLERANCE)
    fitted = one.select("all", F.aggregate(
        F.sequence(F.lit(1), F.lit(2 * MAX_STEPS)), start,
        lambda state, k: F.when(~moving(state), state).when(k % 2 == 1, estimate(state)).otherwise(expect(state))).alias("fit"))
    g = F.when(moving(F.col("fit")), F.raise_error(F.lit(f"quality rules: the fit still moves after {MAX_STEPS} steps"))).otherwise(F.col("fit.post.g"))
    return fitted.select(F.explode(F.arrays_zip(F.col("all.pattern").alias("pattern"), g.alias("g"))).alias("x")) \
        .select(F.col("x.pattern").alias("pattern"), F.get(F.col("x.g"), F.lit(0)).alias("posterior"))


def judged(feats: DataFrame) -> DataFrame:
    """Adds ``pattern``, ``posterior``, ``base_failed`` and ``kept`` to a frame
    with the feature columns, which is read twice: once for the pattern
    counts, once for the verdicts."""
    voted = feats.withColumn("pattern", vote_pattern())
    fit = posteriors(voted.groupBy("pattern").agg(F.count("*").alias("n")))
    # at most 3**N_RULES rows
    out = voted.join(F.broadcast(fit), "pattern").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= THRESHOLD))


def score(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Features and verdict of every row; ``keep`` names the input columns to
    carry along, all by default. The features are written once and reread for
    the pattern counts and for the verdicts; it also keeps the optimizer from
    copying their expressions into a filter on the verdict."""
    return judged(written_table(with_features(docs, text, keep), "quality"))


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the verdict keeps, all columns as they were."""
    return unpacked(score(docs, text).where("kept"), docs.columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, keep=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same counts by unnesting, the same fit as a recursive query over one
    row of vote patterns (lists are numbered from 1 there)."""
    words, space, steps = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]", N_RULES + 1
    # place of a vote in a rate pair; a rule for a defect that finds none has voted
    vote = lambda bad, good="true": f"CASE WHEN {bad} THEN 1 WHEN {good} THEN 0 ELSE 2 END"
    two_sided = [name not in ONE_SIDED for name in RULE_NAMES]
    capped = lambda x: f"ln(least(greatest({x}, {RULE_ERROR}), {1 - RULE_ERROR}))"
    length = "(word_chars / greatest(n_words, 1))"
    votes = ", ".join([
        vote(f"n_words < {MIN_WORDS}", "n_words >= 50"),
        vote("n_symbols / greatest(n_words, 1) > 0.1"),
        vote("n_repeat_words / greatest(n_words, 1) > 0.2"),
        vote("n_dup_lines / greatest(n_lines, 1) > 0.3"),
        vote("n_stutters / greatest(n_words, 1) > 0.2"),
        vote(f"n_words > 0 AND NOT ({length} BETWEEN 2.5 AND 12)", f"{length} BETWEEN 3.5 AND 8"),
        vote("n_words > 0 AND n_ended_lines / greatest(n_lines, 1) < 0.3", "n_words > 0 AND n_ended_lines / greatest(n_lines, 1) >= 0.7"),
        vote("n_upper / greatest(word_chars, 1) > 0.3")])
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{words}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{words}')) AS lines
  FROM documents),
grams AS (SELECT rn, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM (SELECT rn, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT rn, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS n
  FROM (SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS next FROM twice) GROUP BY rn),
f AS (
  SELECT rn, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…。]{space}*\z'))) AS n_ended_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (rn)),
voted AS (SELECT *, [{votes}] AS v FROM f),
shares AS (SELECT v, n / sum(n) OVER () AS n FROM (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY v)),
off AS (
  SELECT list(off ORDER BY j) AS off FROM (
    SELECT j, {two_sided}[j + 1] AND coalesce(sum(n) FILTER (v[j + 1] = 1), 0) > coalesce(sum(n) FILTER (v[j + 1] = 0), 0) AS off
    FROM shares CROSS JOIN (SELECT unnest(range({N_RULES})) AS j) GROUP BY j)),
used AS (SELECT v, n, list_transform(v, lambda x, j: CASE WHEN off[j] THEN 2 ELSE x END) AS u FROM shares CROSS JOIN off),
em(k, post) AS (
  SELECT 0, list({{'n': n, 'v': v, 'u': u, 'g': list_transform(range({steps}), lambda c:
    CASE WHEN NOT list_contains(u, 1) THEN CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END
         WHEN c = 0 THEN 0.1 ELSE CASE WHEN u[c] = 1 THEN 0.9 ELSE 0.0 END / len(list_filter(u, lambda x: x = 1)) END::DOUBLE), 'moved': 1::DOUBLE}} ORDER BY v)
  FROM used
  UNION ALL
  SELECT k + 1, list_transform(likely, lambda p: {{'n': p.n, 'v': p.v, 'u': p.u, 'g': list_transform(p.g, lambda x: x / list_sum(p.g)),
                                                   'moved': abs(p.g[1] / list_sum(p.g) - p.moved)}})
  FROM (
    SELECT k, list_transform(post, lambda p: {{'n': p.n, 'v': p.v, 'u': p.u, 'g': list_transform(range({steps}), lambda c:
      CASE WHEN c > 0 AND p.u[c] <> 1 THEN 0.0
           ELSE exp(weight[c + 1] + list_sum(list_transform(range({N_RULES}), lambda j: rate[c + 1][j + 1][p.u[j + 1] + 1]))) END), 'moved': p.g[1]}}) AS likely
    FROM (
      SELECT k, post, weight, list_transform(range({steps}), lambda c: list_transform(range({N_RULES}), lambda j:
               CASE WHEN c = j + 1 THEN [0.0, 0.0, 0.0] WHEN c = 0 THEN [ln({1 - RULE_ERROR}), ln({RULE_ERROR}), 0.0]
                    ELSE [{capped("cast_[c + 1][j + 1][1] / list_sum(cast_[c + 1][j + 1])")}, {capped("cast_[c + 1][j + 1][2] / list_sum(cast_[c + 1][j + 1])")}, 0.0] END)) AS rate
      FROM (
        SELECT k, post,
               list_transform(range({steps}), lambda c: ln((list_sum(list_transform(post, lambda p: p.n * p.g[c + 1])) + {PSEUDO}) / {1 + steps * PSEUDO})) AS weight,
               list_transform(range({steps}), lambda c: list_transform(range({N_RULES}), lambda j: list_transform(range(2), lambda t:
                 list_sum(list_transform(post, lambda p: CASE WHEN p.u[j + 1] = t THEN p.n * p.g[c + 1] ELSE 0.0 END)) + {PSEUDO} * {list(PRIOR_OTHER)}[t + 1]))) AS cast_
        FROM em WHERE k < {MAX_STEPS} AND len(list_filter(post, lambda p: p.moved > {TOLERANCE})) > 0)))),
fit AS (SELECT p.v AS v, p.g[1] AS posterior FROM (SELECT unnest(post) AS p FROM (SELECT post FROM em ORDER BY k DESC LIMIT 1))),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM voted JOIN fit USING (v))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND posterior >= {THRESHOLD} AS kept
FROM judged
"""


OP3_SQL = _sql()
