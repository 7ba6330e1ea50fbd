"""From volunteers' classifications to consensus observations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens import schema
from fieldlens.functions import parsing
from fieldlens.operators.findings import emit, finding
from fieldlens.session import stored

# The id stands first, since a sort compares rows by eight bytes of its first column before it looks at the others.
SUBJECT = ("sid", "media_id", "workflow_key", "workflow_id")
K_MAX = 3


# --- export to classifications ---


def classification_table(
    export: DataFrame,
    *,
    keep_subject: Column | None = None,
    subjects: DataFrame | None = None,
    legacy: bool = False,
) -> DataFrame:
    """One row per classification and subject of an export; ``annotations`` stays the cell's text.

    ``keep_subject`` is a predicate on ``sid``; ``subjects`` restricts to the members of a table.
    """
    key = F.concat_ws(
        ":",
        F.coalesce("workflow_id", F.lit("unknown_id")),
        F.coalesce("workflow_name", F.lit("unknown_workflow")),
        F.coalesce("workflow_version", F.lit("")),
    )
    ids = parsing.subject_ids(F.col("subject_ids"), legacy=legacy)
    rows = export.select(
        "classification_id",
        "user_name",
        "user_id",
        "workflow_id",
        key.alias("workflow_key"),
        # Outer, so that the ids are not parsed a second time to drop empty lists before the explode.
        F.explode_outer(ids).alias("sid"),
        "subject_data",
        "annotations",
    ).where("sid IS NOT NULL")
    if keep_subject is not None:
        rows = rows.where(keep_subject)
    if subjects is not None:
        rows = rows.join(subjects.select("sid"), "sid", "left_semi")
    record = parsing.subject_record(F.col("subject_data"), F.col("sid"))
    rows = rows.withColumn("_record", record)
    name = parsing.first_key(F.col("_record"), parsing.EXPORT_NAME_KEYS)
    reason = parsing.retirement_reason(F.col("_record"))
    return rows.withColumns(
        {
            "subject_name": name,
            "media_id": parsing.labelled_media_id(name),
            "retired": reason.isNotNull(),
            "retirement_reason": reason,
        }
    ).drop("_record", "subject_data")


def rows_without_subject(export: DataFrame, *, legacy: bool = False) -> DataFrame:
    """Findings for export rows that name no subject."""
    ids = parsing.subject_ids(F.col("subject_ids"), legacy=legacy)
    message = F.lit("No subject id could be read")
    return emit(
        export, [finding(F.size(ids) == 0, F.col("classification_id"), "read export", "error", message)]
    )


def workflow_summary(classified: DataFrame) -> DataFrame:
    """Rows, retired rows, distinct subjects and retired share per workflow version.

    Subjects are reduced first, so one busy workflow is spread over its subjects.
    """
    subjects = classified.groupBy("workflow_key", "sid").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("retirement_reason") != "").alias("_retired")
    )
    totals = subjects.groupBy("workflow_key").agg(
        F.sum("_rows").alias("total_rows"),
        F.sum("_retired").alias("retired_rows"),
        F.count(F.lit(1)).alias("distinct_subjects"),
        F.count_if(F.col("_retired") > 0).alias("retired_subjects"),
    )
    return totals.withColumn("retired_pct", 100 * F.col("retired_subjects") / F.col("distinct_subjects"))


def classifications_per_subject(classified: DataFrame) -> DataFrame:
    return classified.groupBy("workflow_key", "sid", "media_id").agg(
        F.count(F.lit(1)).alias("n_classifications")
    )


def choice_histogram(classified: DataFrame) -> DataFrame:
    """Votes per choice of every subject, with the place of the first one.

    Choices are counted per classification value: plain strings and objects alike.
    """
    columns = ["workflow_key", "sid", "classification_id"]
    read = parsing.with_values(classified.select(*columns, "annotations"), "annotations", "_values")
    return (
        read.select(*columns, F.posexplode_outer("_values").alias("pos", "_value"))
        .select(*columns, "pos", F.col("_value")["choice"].alias("choice"))
        .where("choice IS NOT NULL")
        .groupBy("workflow_key", "sid", "choice")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("classification_id", "pos")).alias("first_seen"))
    )


def majority_choice(histogram: DataFrame) -> DataFrame:
    """Most frequent choice per subject; the first seen wins a tie."""
    best = F.struct(-F.col("n"), F.col("first_seen"))
    return histogram.groupBy("workflow_key", "sid").agg(
        F.min_by("choice", best).alias("majority_choice"), F.max("n").alias("n")
    )


# --- rules ---


@dataclass(frozen=True)
class ConsensusRule:
    """How one workflow's classifications become decisions.

    ``unknown_taxon`` replaces choices outside the table; None passes them through. With
    ``skip_odd_sizes`` classifications with no choice or more than K_MAX are ignored.
    """

    taxa: Mapping[str, str] = field(default_factory=dict)
    unknown_taxon: str | None = None
    skip_odd_sizes: bool = True


RULES = {
    "29186": ConsensusRule(schema.TAXA_IBERIA),
    "17553": ConsensusRule(schema.TAXA_IBERIA),
    "29187": ConsensusRule(schema.TAXA_MOUNTAIN, unknown_taxon="unknown", skip_odd_sizes=False),
}


def taxa_table(spark, rules: Mapping[str, ConsensusRule] = RULES) -> DataFrame:
    """The choice tables as a dimension (workflow_id, choice, taxon)."""
    rows = [(w, c, t) for w, rule in rules.items() for c, t in rule.taxa.items()]
    return spark.createDataFrame(rows, "workflow_id string, choice string, taxon string")


def _taxon(choice: Column, rule: ConsensusRule) -> Column:
    if not rule.taxa:
        return choice
    pairs = [part for c, t in rule.taxa.items() for part in (F.lit(c), F.lit(t))]
    other = choice if rule.unknown_taxon is None else F.lit(rule.unknown_taxon)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), choice), other)


def _by_rule(build: Callable[[ConsensusRule], Column], rules: Mapping[str, ConsensusRule], other: Column) -> Column:
    """One expression over all workflows instead of one scan per workflow."""
    result = other
    for workflow, rule in rules.items():
        result = F.when(F.col("workflow_id") == workflow, build(rule)).otherwise(result)
    return result


def tally(
    classified: DataFrame, rules: Mapping[str, ConsensusRule] = RULES, *, legacy: bool = False
) -> DataFrame:
    """Votes of every subject, in two kinds of rows.

    kind ``k``: how many classifications (``n``) gave ``value`` choices. kind ``taxon``: how often a
    taxon was chosen, its first place in document order, and the number of individuals, which is the
    median of the all-digit HOWMANY answers rounded up.

    The annotations are parsed once and exploded once. Votes are first counted per answer, with partial
    counts before the shuffle, so a subject that holds a large share of all votes stays small; the median is
    then read off the counts of the few distinct numbers, and all further steps on subjects share the
    second shuffle. ``legacy`` leaves choices unmapped where the rule names an unknown taxon.
    """
    known = classified.where(F.col("workflow_id").isin(list(rules)))
    read = parsing.with_choices(
        known.select(*SUBJECT, "classification_id", "annotations"), "annotations", "_choices"
    )
    size = F.size("_choices")
    skip = _by_rule(lambda r: F.lit(r.skip_odd_sizes), rules, F.lit(True))

    def taxon(raw: Column) -> Column:
        def of_rule(rule: ConsensusRule) -> Column:
            return raw if legacy and rule.unknown_taxon is not None else _taxon(raw, rule)

        return _by_rule(of_rule, rules, raw)

    # A skipped classification, like one without choices, gives a row without a choice. The size test is
    # part of the exploded value and the explode is outer: as filters before it, both would make the plan
    # parse every cell once more.
    counted = F.when(~skip | size.between(1, K_MAX), F.col("_choices"))
    votes = read.select(*SUBJECT, "classification_id", size.alias("_size"), F.posexplode_outer(counted).alias("pos", "_vote"))
    choice = F.col("_vote")["choice"]
    number = parsing.whole_number(F.try_element_at(F.col("_vote")["answers"], F.lit("HOWMANY")))
    answers = (
        votes.where(choice.isNotNull() | (~skip & (F.col("_size") == 0)))
        .select(*SUBJECT, "classification_id", "pos", "_size", choice.alias("choice"), number.alias("number"))
        .groupBy(*SUBJECT, "_size", "choice", "number")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("classifications"),
            F.min(F.struct("classification_id", "pos")).alias("first_vote"),
        )
    )
    # Each answer is a vote for its taxon; the first choice of a classification stands for its size.
    nothing = F.lit(None).cast("bigint")
    item = F.array(
        F.struct(F.lit("taxon").alias("kind"), F.when(F.col("choice").isNotNull(), taxon(F.col("choice"))).alias("value"), "number", "n", "first_vote"),
        F.struct(
            F.lit("k").alias("kind"), F.col("_size").cast("string").alias("value"), nothing.alias("number"),
            F.col("classifications").alias("n"), "first_vote",
        ),
    )
    # Answers are shuffled before they become two rows each.
    items = (
        answers.repartition(*[F.col(c) for c in SUBJECT])
        .select(*SUBJECT, F.inline(item))
        .where("n > 0 AND value IS NOT NULL")
    )
    # Both sums have the same order, so one pass over the rows gives them.
    same = Window.partitionBy(*SUBJECT, "kind", "value").orderBy("number")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    given = F.when(F.col("number").isNotNull(), F.col("n"))
    placed = items.withColumns({"_upto": F.sum(given).over(same), "_all": F.sum(given).over(whole)})
    low = F.min(F.when(F.col("_upto") >= F.expr("(_all + 1) div 2"), F.col("number")))
    high = F.min(F.when(F.col("_upto") >= F.expr("_all div 2 + 1"), F.col("number")))
    counts = placed.groupBy(*SUBJECT, "kind", "value").agg(
        F.sum("n").alias("n"), F.min("first_vote").alias("first_vote"), low.alias("_low"), high.alias("_high")
    )
    # Half way between the two middle numbers, rounded up.
    return counts.withColumn("individuals", F.expr("_low + (_high - _low + 1) div 2")).drop("_low", "_high")


def _most_frequent(n: Column, k: Column) -> Column:
    """Sort key of the choice-count vote as one number: more classifications first, then the largest allowed k."""
    return n * (K_MAX + 2) + F.when(k <= K_MAX, k).otherwise(-1) + 1


def _allowed(key: Column) -> Column:
    """The number of choices in such a key; -1 if it is none that is allowed."""
    return key % (K_MAX + 2) - 1


def k_majority(tallied: DataFrame) -> DataFrame:
    """The most frequent number of choices per subject; the larger wins a tie.

    Null when only numbers above K_MAX are most frequent: such a subject has no decision.
    """
    best = (
        tallied.where("kind = 'k'")
        .groupBy(*SUBJECT)
        .agg(F.max(_most_frequent(F.col("n"), F.col("value").cast("bigint"))).alias("_best"))
    )
    allowed = _allowed(F.col("_best"))
    return best.select(*SUBJECT, F.when(allowed >= 0, allowed).alias("k_majority"))


def top_species(tallied: DataFrame, *, legacy: bool = False) -> DataFrame:
    """The k+1 most voted taxa per subject with rank and confidence.

    Confidence is votes against the next taxon inside the cut, 1 for the last. ``blank`` is dropped
    when volunteers mostly name several choices, unless ``legacy``. The rows of a subject are its
    distinct taxa and choice counts, so its window is small; all windows share one shuffle.
    """
    subject = Window.partitionBy(*SUBJECT)
    frequent = F.when(
        F.col("kind") == "k", _most_frequent(F.col("n"), F.col("value").cast("bigint"))
    )
    rows = (
        tallied.withColumn("k_majority", _allowed(F.max(frequent).over(subject)))
        .where("kind = 'taxon' AND k_majority >= 0")
        .withColumnsRenamed({"value": "taxon", "n": "votes"})
        .drop("kind")
    )
    if not legacy:
        rows = rows.where(~((F.col("k_majority") > 1) & (F.col("taxon") == "blank")))
    ranked = subject.orderBy(F.desc("votes"), "first_vote")
    cut = F.greatest(F.lit(1), F.col("k_majority") + 1)
    # The next taxon is looked up in the same pass as the rank; beyond the cut it does not count.
    kept = rows.withColumns(
        {"rank": F.row_number().over(ranked).cast("bigint"), "_following": F.lead("votes").over(ranked)}
    ).where(F.col("rank") <= cut)
    following = F.when(F.col("rank") < cut, F.col("_following"))
    confidence = F.coalesce(F.col("votes") / (F.col("votes") + following), F.lit(1.0))
    return kept.withColumn("confidence", confidence).drop("_following")


def observation_type(taxon: Column, *, legacy: bool = False) -> Column:
    """Type of a decision. ``legacy`` takes the word human for an animal's name."""
    people = ["Homo sapiens"] if legacy else ["Homo sapiens", "human"]
    plain = ["vehicle", "blank", "unclassified", "unknown"]
    return F.when(taxon.isin(people), "human").when(taxon.isin(plain), taxon).otherwise("animal")


def scientific_name(taxon: Column, *, legacy: bool = False) -> Column:
    plain = ["vehicle", "blank", "unclassified", "unknown", "animal"] + ([] if legacy else ["human"])
    return F.when(taxon.isin(plain), "").otherwise(taxon)


def confidence_text(confidence: Column) -> Column:
    """Two decimals, halves to the even digit."""
    return F.format_string("%.2f", F.bround(confidence, 2))


def decisions(
    classified: DataFrame,
    rules: Mapping[str, ConsensusRule] = RULES,
    *,
    source: str = "volunteers",
    legacy: bool = False,
) -> DataFrame:
    """Consensus observations per subject.

    ``legacy``: blank is no allowed type, so a subject with it among its decisions has none at all.
    """
    top = top_species(tally(classified, rules, legacy=legacy), legacy=legacy)
    taxon = F.col("taxon")
    comment = F.concat(
        F.lit(f"Automatically classified by {source} for subject "),
        F.col("sid").cast("string"),
        F.lit(" with confidence "),
        confidence_text(F.col("confidence")),
    )
    result = top.select(
        *SUBJECT,
        "rank",
        "votes",
        "confidence",
        observation_type(taxon, legacy=legacy).alias("observation_type"),
        scientific_name(taxon, legacy=legacy).alias("scientific_name"),
        F.col("individuals").alias("count"),
        comment.alias("comments"),
    )
    if legacy:
        whole = Window.partitionBy(*SUBJECT)
        rejected = F.max(F.col("observation_type") == "blank").over(whole)
        result = result.withColumn("_rejected", rejected).where("NOT _rejected").drop("_rejected")
    return result


def decisions_by_user_rule(
    tallied: DataFrame, decide: Callable[[pd.DataFrame], pd.DataFrame], output: str
) -> DataFrame:
    """Decisions of a Python rule on the tally.

    The rule gets frames of many whole subjects, ordered by subject, so it can work on whole columns;
    a call per subject would spend most of its time on the call. A subject's rows are its distinct
    answers, however many volunteers there are.
    """
    flat = tallied.select(
        *SUBJECT, "kind", "value", "n", "individuals",
        F.col("first_vote.classification_id").alias("first_id"), F.col("first_vote.pos").alias("first_pos"),
    )
    keys = list(SUBJECT)

    def whole_subjects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if frame.empty:
                continue
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = frame.iloc[-1]
            # The rows of the last subject stay for the next frame, which may hold more of them.
            open_subject = pd.Series(True, index=frame.index)
            for key in keys:
                open_subject &= frame[key].isna() if pd.isna(last[key]) else frame[key] == last[key]
            held = frame[open_subject]
            if not open_subject.all():
                yield decide(frame[~open_subject])
        if held is not None:
            yield decide(held)

    together = flat.repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInPandas(whole_subjects, output)


# --- fan-out to archive observations ---


def fan_out(
    decided: DataFrame,
    observations: DataFrame,
    *,
    classified_by: str,
    copied: Sequence[str] = (),
    source: str = "volunteers",
) -> DataFrame:
    """Every decision on every distinct observation id of the subject's media.

    Attributes in ``copied`` come from the media's first observation (lowest id). Decisions are at most
    K_MAX + 1 rows per subject, so the join grows with the observations; a hot media file is a skewed
    join key, which adaptive execution splits.
    """
    keyed = observations.withColumn("media_id", F.col("media_id").cast("string"))
    ids = keyed.where(F.col("obs_id").isNotNull()).select("media_id", "obs_id").distinct()
    fields = decided
    if copied:
        first = keyed.groupBy("media_id").agg(
            F.min_by(F.struct(*copied), "obs_id").alias("_first")
        )
        fields = decided.join(first, "media_id").select(
            decided["*"], *[F.col(f"_first.{c}").alias(c) for c in copied]
        )
    comment = F.concat(
        F.lit(f"Automatically classified by {source} in workflow "),
        F.col("workflow_key"),
        F.lit(" for subject "),
        F.col("sid").cast("string"),
    )
    return fields.join(ids, "media_id").withColumns(
        {
            "classified_by": F.lit(classified_by),
            "classification_method": F.lit("human"),
            "classified_at": F.current_timestamp(),
            "bboxes": F.lit(None).cast("string"),  # boxes of the copied observation do not hold any more
            "comments": comment,
        }
    )


def fan_out_findings(fanned: DataFrame) -> DataFrame:
    """A success for every decision put on an observation."""
    who = F.concat(F.lit("subject:"), F.col("sid").cast("string"))
    message = F.concat(
        F.lit("Observation added to media "), F.col("media_id"), F.lit(": "), F.coalesce("scientific_name", F.lit("no taxon"))
    )
    return emit(fanned, [finding(F.lit(True), who, "getting_decision", "success", message)])


def undecided(classified: DataFrame, decided: DataFrame, observations: DataFrame) -> DataFrame:
    """Findings for subjects whose media has no observations, or which got no decision."""
    subjects = classified.select(*SUBJECT).distinct()
    media = observations.select(F.col("media_id").cast("string").alias("_media")).distinct()
    held = decided.select(*[F.col(c).alias(f"_{c}") for c in SUBJECT]).distinct()
    same = [subjects[c].eqNullSafe(held[f"_{c}"]) for c in SUBJECT]
    rows = (
        subjects.join(media.withColumn("_has_observations", F.lit(True)), subjects["media_id"] == media["_media"], "left")
        .join(held.withColumn("_decided", F.lit(True)), same, "left")
    )
    who = F.concat(F.lit("subject:"), F.col("sid").cast("string"))
    observed = F.col("_has_observations").isNotNull()
    return emit(
        rows,
        [
            finding(
                ~observed, who, "get_observations", "error",
                F.concat(F.lit("Media without observations: "), F.coalesce("media_id", F.lit("None"))),
            ),
            finding(
                observed & F.col("_decided").isNull(), who, "getting_decision", "error",
                F.concat(F.lit("Undecided subject "), F.col("sid").cast("string")),
            ),
        ],
    )


def consensus_observations(
    export: DataFrame,
    observations: DataFrame,
    *,
    classified_by: str,
    rules: Mapping[str, ConsensusRule] = RULES,
    copied: Sequence[str] = (),
    subjects: DataFrame | None = None,
    legacy: bool = False,
) -> DataFrame:
    """Export to archive observations: parse, vote, fan out."""
    classified = classification_table(export, subjects=subjects, legacy=legacy)
    # Few and narrow rows; stored, the join's filter on the media id meets a plain column, and the
    # cells of the export are parsed once.
    decided = stored(decisions(classified, rules, legacy=legacy), "decisions")
    return fan_out(decided, observations, classified_by=classified_by, copied=copied)
