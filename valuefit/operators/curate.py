"""Curating question tables: filters with reasons, template dedup, leakage joins, splits, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from valuefit.functions import text as t
from valuefit.sources.scratch import shared_folder


def no(c: Column) -> Column:
    """Not true; a null counts as not true."""
    return ~F.coalesce(c, F.lit(False))


# --- P: predicates -------------------------------------------------------------------------------------------------


def metadata_ok(source: str = "cn_k12", kind: str = "math-word-problem") -> Column:
    """Source and metadata as asked for; a null fails, and ``synthetic`` has to be false itself."""
    return (
        F.col("source").eqNullSafe(source) & F.col("synthetic").eqNullSafe(False) & F.col("question_type").eqNullSafe(kind)
        & F.col("problem_is_valid").eqNullSafe("Yes") & F.col("solution_is_valid").eqNullSafe("Yes")
    )


def blank(c: Column) -> Column:
    """P5."""
    return c.isNull() | ~c.rlike(r"[^\s\x1c-\x1f\x85\xa0]")


def not_text(c: Column) -> Column:
    """P2."""
    return F.coalesce(c.rlike(t.NOT_TEXT), F.lit(False))


def diagram(c: Column) -> Column:
    """P3."""
    return F.coalesce(c.rlike(t.DIAGRAM), F.lit(False))


def many_answers(c: Column) -> Column:
    """P4."""
    return F.coalesce(c.rlike(t.MANY_ANSWERS), F.lit(False))


def prompt_too_long(n: Column, most: int) -> Column:
    """No tokens or more than ``most``."""
    return no((n > 0) & (n <= most))


def context_too_long(n: Column, new: int, most: int) -> Column:
    return no(n + new <= most)


def held_out_source(c: Column, tags=("gsm8k", "math")) -> Column:
    """P10."""
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*tags)


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that holds, in order; null if none does."""
    return F.coalesce(*(F.when(c, F.lit(k)) for k, c in checks))


def all_reasons(checks: dict[str, Column], sep: str = "|") -> Column:
    """The names of all checks that hold; null if none does."""
    return F.nullif(F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items()))), sep), F.lit(""))


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """A1 of rejected rows."""
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("rows"))


def overlong_prompts(df: DataFrame, n: Column, most: int, drop: bool) -> tuple[DataFrame, int]:
    """Drop prompts over the limit and count them, or fail on the first."""
    over = df.where(n > most).count()
    if over and not drop:
        raise ValueError(f"{over} prompts are longer than {most} tokens")
    return df.where(no(n > most)), over


# --- D: selection by key -------------------------------------------------------------------------------------------


def mark_duplicates(df: DataFrame, passes: Column, index: str = "source_index", family: str = "family") -> DataFrame:
    """Adds ``first_index``, the first index of the family whose row passes all checks, and ``duplicate``.

    A family is seen only once a row of it has passed everything, so rows before it keep their own reasons.  The
    least index is a partial aggregation on a hash of the family; a hot family is never gathered.
    """
    key = F.sha2(F.col(family), 256)
    first = df.where(passes).groupBy(key.alias("_key")).agg(F.min(index).alias("first_index"))
    out = df.withColumn("_key", key).join(first, "_key", "left").drop("_key")
    return out.withColumn("duplicate", F.coalesce(F.col(index) > F.col("first_index"), F.lit(False)))


def select_eligible(df: DataFrame, early: dict[str, Column], late: dict[str, Column], label: str = "duplicate_family") -> DataFrame:
    """P8 and D1 together: ``reason`` of each row, with the duplicate test between the early and the late checks."""
    good = reduce(lambda a, b: a & b, (no(c) for c in [*early.values(), *late.values()]), F.lit(True))
    marked = mark_duplicates(df, good)
    reason = first_reason(*early.items(), (label, F.col("duplicate")), *late.items())
    return marked.withColumn("reason", reason).drop("duplicate", "first_index")


def eligible_reasons(df: DataFrame, early: dict[str, Column], late: dict[str, Column], label: str = "duplicate_family", index: str = "source_index", keep: tuple[str, ...] = ()) -> DataFrame:
    """P8 and D1 for callers who need only (index, columns of ``keep``, reason): each text is read and judged once.

    Index, kept columns, hash of the family and the two reasons are written to the shared folder; families then meet in that narrow
    table, so no text is shuffled and no check is made twice.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "reasons")
    judged = df.select(F.col(index).alias("_index"), *keep, F.sha2("family", 256).alias("family"), first_reason(*early.items()).alias("_early"), first_reason(*late.items()).alias("_late"))
    judged.write.parquet(path)
    marked = mark_duplicates(spark.read.parquet(path), F.col("_early").isNull() & F.col("_late").isNull(), "_index")
    return marked.select(F.col("_index").alias(index), *keep, F.coalesce("_early", F.when(F.col("duplicate"), F.lit(label)), "_late").alias("reason"))


def prepare_questions(df: DataFrame, max_prompt: int, max_new: int, max_context: int, solution: str | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The general path: rows (source_index, question, answer, n_tokens[, solution]) with ``family``, ``number``, ``reason``.

    With ``keep`` only the index, these columns and the reason: texts are then judged once and not shuffled."""
    df = df.withColumn("family", t.family_key("question")).withColumn("number", t.parse_number(F.col("answer")))
    early = {"empty_question": blank(F.col("question")), "unsupported_reference": F.col("number").isNull()}
    if solution:
        df = df.withColumn("decision", t.reference_decision(F.col("question"), F.col(solution), F.col("answer")))
        early["reference_audit"] = no(F.col("decision.eligible"))
    early |= {"diagram": diagram(F.col("question")), "multiple_answers": many_answers(F.col("question"))}
    late = {"prompt_length": prompt_too_long(F.col("n_tokens"), max_prompt), "native_context": context_too_long(F.col("n_tokens"), max_new, max_context)}
    return select_eligible(df, early, late) if keep is None else eligible_reasons(df, early, late, keep=keep)


def prepare_tagged(df: DataFrame, blocked: DataFrame, max_prompt: int = 512) -> DataFrame:
    """The metadata path: joined reference reasons, and one reason for blocked and repeated families."""
    df = df.withColumn("question", F.trim("problem")).withColumn("family", t.family_key("question"))
    df = df.withColumn("decision", t.reference_decision(F.col("question"), F.col("solution"), F.col("answer")))
    df = df.join(blocked.select(F.sha2("family", 256).alias("_b")).distinct(), F.sha2("family", 256) == F.col("_b"), "left")
    early = {
        "source_or_metadata": no(metadata_ok()), "non_text_or_proof": not_text(F.col("question")),
        "reference": no(F.col("decision.eligible")), "overlap_or_duplicate": F.col("_b").isNotNull(),
    }
    out = select_eligible(df, early, {"prompt_length": prompt_too_long(F.col("n_tokens"), max_prompt)}, "overlap_or_duplicate")
    joined = F.array_join("decision.reasons", "|")
    return out.withColumn("reason", F.when(F.col("reason") == "reference", joined).otherwise(F.col("reason"))).drop("_b")


def exclude_families(df: DataFrame, blocked: DataFrame, family: str = "family") -> DataFrame:
    """Rows whose family is in no other set.  A null family stays.  Spark broadcasts a small block list itself."""
    keys = blocked.select(F.sha2(F.col(family), 256).alias("_b")).where("_b is not null").distinct()
    return df.join(keys, F.sha2(F.col(family), 256) == F.col("_b"), "left_anti")


def keep_questions(df: DataFrame, chosen: DataFrame, key: str = "question") -> DataFrame:
    """Rows of chosen questions."""
    return df.join(chosen.select(key).distinct(), key, "left_semi")


def attach_questions(answers: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """Question attributes on answers; an unknown id is an error."""
    unknown = answers.join(questions.withColumnRenamed("id", key), key, "left_anti").limit(1).count()
    if unknown:
        raise ValueError("answers of unknown questions")
    return answers.join(questions.withColumnRenamed("id", key), key)


def top_by_hash(df: DataFrame, n: int | None, seed: int | str, ident: str = "id") -> DataFrame:
    """The first ``n`` rows in hash order (all: None); too few are an error."""
    if n is None:
        return df
    found = df.orderBy(t.order_key(seed, F.col(ident)), ident).limit(n)
    if (m := found.count()) < n:
        raise ValueError(f"only {m} rows of {n}")
    return found


def ranked(df: DataFrame, *order: Column | str, out: str = "rank", per_range: int = 100_000, most: int = 500) -> DataFrame:
    """A global rank from 0 in a total, ascending order of columns without nulls.

    Rows fall into ranges of about ``per_range`` by bounds from a bounded sample of keys; a rank is the number of rows in
    earlier ranges and the row's number in its own, so no task has all rows.  Any bounds give the same ranks.
    """
    key = F.struct(*((F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)))
    keyed = df.select("*", key.alias("_key"))
    n = df.count()
    ranges = min(most, max(1, n // per_range))
    at = F.lit(0)
    if ranges > 1:
        some = sorted(tuple(r[0]) for r in keyed.select("_key").sample(min(1.0, 100 * ranges / n), seed=0).limit(400 * ranges).collect())
        kinds = [f.dataType for f in keyed.schema["_key"].dataType.fields]
        bounds = [F.struct(*(F.lit(v).cast(k).alias(f"k{i}") for i, (v, k) in enumerate(zip(some[j * len(some) // ranges], kinds)))) for j in range(1, ranges)]
        at = F.size(F.filter(F.array(*bounds), lambda b: b <= F.col("_key")))
    keyed = keyed.withColumn("_range", at)
    held = {r[0]: r[1] for r in keyed.groupBy("_range").count().collect()} if ranges > 1 else {}
    before = F.array(*(F.lit(sum(v for k, v in held.items() if k < i)).cast("long") for i in range(ranges)))
    number = F.row_number().over(W.partitionBy("_range").orderBy("_key")) - 1
    return keyed.select(*df.columns, (number + F.get(before, F.col("_range"))).cast("long").alias(out))


def split_share(df: DataFrame, seed: int | str, ident: str = "id", shares=(0.6, 0.2)) -> DataFrame:
    """Train, val and test by rank in hash order; cut points truncate as Python's do."""
    n = df.count()
    train, val = int(shares[0] * n), int(shares[1] * n)
    r = F.col("rank")
    split = F.when(r < train, "train").when(r < train + val, "val").otherwise("test")
    return ranked(df, t.order_key(seed, F.col(ident)), ident).withColumn("split", split).drop("rank")


def split_counts(df: DataFrame, counts: dict[str, int], order: Column, *ties: str) -> DataFrame:
    """Named counts in order; rows beyond them go, too few are an error."""
    total = sum(counts.values())
    chosen = df.orderBy(order, *ties).limit(total)
    if (m := chosen.count()) < total:
        raise ValueError(f"only {m} rows of {total}")
    split, low = None, 0
    for name, k in counts.items():
        low += k
        split = (F.when if split is None else split.when)(F.col("rank") < low, name)
    return ranked(chosen, order, *ties).withColumn("split", split).drop("rank")


def two_folds(df: DataFrame, seed: int | str, ident: str = "id", least: int = 4) -> DataFrame:
    """(id, fold): ids in hash order, alternating between fold 0 and 1."""
    ids = df.select(F.col(ident).cast("string").alias(ident)).distinct()
    if ids.count() < least:
        raise ValueError(f"fewer than {least} ids")
    return ranked(ids, t.order_key(seed, F.col(ident)), ident).select(ident, (F.col("rank") % 2).cast("int").alias("fold"))


def split_problems(df: DataFrame, blocked: DataFrame | None = None, least: dict[str, int] | None = None) -> DataFrame:
    """(problem, n): families in several splits, repeated families and ids, blocked families, short splits."""
    fam = df.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("s"))
    one = lambda name, frame: frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    out = one("family_in_several_splits", fam.where("s > 1")).unionByName(one("repeated_family", fam.where("n > 1")))
    out = out.unionByName(one("repeated_id", df.groupBy("id").count().where("count > 1")))
    if blocked is not None:
        out = out.unionByName(one("blocked_family", df.join(blocked.select("family").distinct(), "family", "left_semi")))
    for name, k in (least or {}).items():
        short = df.where(F.col("split") == name).agg(F.greatest(F.lit(k) - F.count(F.lit(1)), F.lit(0)).cast("long").alias("n"))
        out = out.unionByName(short.select(F.lit(f"short_{name}").alias("problem"), "n"))
    return out


def plain_space(c: Column) -> Column:
    """White space collapsed to single spaces."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def exact_overlap(a: DataFrame, b: DataFrame, column: str = "question") -> DataFrame:
    """Texts that both hold, up to white space."""
    return a.select(plain_space(F.col(column)).alias("text")).intersect(b.select(plain_space(F.col(column)).alias("text")))


def first_per_split(df: DataFrame, wanted: dict[str, int], blocked: DataFrame) -> DataFrame:
    """For each split in turn, its first N rows, in source order, of families that are neither blocked nor used.

    Scanning a split stops at N rows, so families it has not come to stay free for the next split.
    """
    taken, out = blocked.select("family"), None
    for split, n in wanted.items():
        own = df.where(F.col("split") == split).join(taken.distinct(), "family", "left_anti")
        first = own.groupBy("family").agg(F.min("source_index").alias("source_index"))
        chosen = own.join(first.orderBy("source_index").limit(n), ["family", "source_index"], "left_semi")
        taken = taken.unionByName(chosen.select("family"))
        out = chosen if out is None else out.unionByName(chosen)
    return out


def nested_budgets(df: DataFrame, budgets: list[int], key: str = "question") -> DataFrame:
    """Rows of the first ``budget`` questions for each budget, with a column ``budget``.

    Each question is ranked once and joined with the few budgets that hold it; subsets are nested.
    """
    order = ranked(df.select(key).distinct(), key)
    holds = F.explode(F.filter(F.array(*(F.lit(b) for b in sorted(budgets))), lambda b: F.col("rank") < b)).alias("budget")
    return df.join(order.select(key, holds), key)


def matched_budget(available: int, budgets: list[int]) -> int:
    """The representation budget that all domains can meet."""
    return min(max(budgets), available)


def pool_two(a: DataFrame, b: DataFrame, budget: int, seed: int, key: str = "question") -> DataFrame:
    """Rows of ``budget`` questions, half of each table (the odd one of the first), chosen in hash order."""
    out = None
    for name, df, n in (("a", a, budget - budget // 2), ("b", b, budget // 2)):
        ids = df.select(key).distinct()
        chosen = ids.orderBy(t.order_key(f"{seed}:{name}", F.col(key).cast("string")), key).limit(n)
        rows = df.join(chosen, key, "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return out


def new_answers(answers: DataFrame, processed: DataFrame) -> DataFrame:
    """Answers whose key is not yet in the ledger; a key whose content has changed is an error."""
    changed = answers.alias("a").join(processed.alias("p"), "key").where("a.content <> p.content").limit(1).count()
    if changed:
        raise ValueError("an answer that was added has changed")
    return answers.join(processed.select("key"), "key", "left_anti")


# --- U: set operations ---------------------------------------------------------------------------------------------


def block_list(*frames: DataFrame) -> DataFrame:
    """Distinct families of several corpora."""
    return reduce(lambda a, b: a.unionByName(b), (f.select("family") for f in frames)).distinct()


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """U2."""
    if not a.select(key).intersect(b.select(key)).isEmpty():
        raise ValueError(f"{key} in both tables")


def missing_ids(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Known ids that did not come back."""
    return known.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def merge_usage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """U4: one table of two; a key in both is an error."""
    out = a.unionByName(b)
    if out.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} in both tables")
    return out


def normalise_rows(df: DataFrame, style: str) -> DataFrame:
    """(source_index, problem, answer, reason) of a corpus with marker-style answers or boxed solutions."""
    if style == "marker":
        out = df.select("source_index", F.col("question").alias("problem"), t.after_marker(F.col("answer")).alias("answer"))
        return out.withColumn("reason", F.when(F.col("answer").isNull(), "no_single_marker").when(t.parse_number(F.col("answer")).isNull(), "not_decimal"))
    decision = t.reference_decision(F.col("problem"), F.col("solution"))
    tag = held_out_source(F.col("source")) if "source" in df.columns else F.lit(False)
    out = df.select("source_index", "problem", decision.alias("d"), tag.alias("tag"))
    reason = F.when(F.col("tag"), "held_out_source_tag").when(no(F.col("d.eligible")), F.array_join("d.reasons", "|"))
    return out.select("source_index", "problem", F.col("d.number").alias("answer"), reason.alias("reason"))


def eligible_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable reference, and the others with their reasons, both with their source index."""
    marked = df.withColumn("d", t.reference_decision(F.col("problem"), F.col("solution")))
    good = marked.where("d.eligible").select(*df.columns, F.col("d.number").alias("reference"))
    return good, marked.where("not d.eligible").select("source_index", F.col("d.reasons").alias("reasons"))


def per_key_rank(df: DataFrame, key: str, *order: Column | str, out: str = "rank") -> DataFrame:
    """A rank from 1 within bounded groups."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(key).orderBy(*order)))
