"""Roll-ups of evaluations: hidden payloads, recompression error, usability study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASKS = ("upload", "interpret_result", "visual_evidence", "history", "report")
RATINGS = ("upload_ease", "result_clarity", "evidence_limitations_clarity")
STATUSES = ("success", "assisted", "failed", "not_run")


def percentage(n: Column, d: Column) -> Column:
    """n of d in percent; 0 of nothing."""
    return F.when(d == 0, 0.0).otherwise(100.0 * n / d)


def stego_outcome(expected: Column, actual: Column, correct: Column) -> Column:
    return (
        F.when(expected & ~actual, "FALSE_NEGATIVE")
        .when(expected & ~F.coalesce(correct, F.lit(False)), "INCORRECT_PAYLOAD")
        .when(~expected & actual, "UNEXPECTED_DETECTION")
        .otherwise("PASS")
    )


def stego_rollup(cases: DataFrame) -> DataFrame:
    """cases (expected, actual, correct, clean) -> one row of counts and rates."""
    e, a, c, clean = (F.col(x) for x in ("expected", "actual", "correct", "clean"))
    counts = cases.agg(
        F.count("*").alias("total_cases"), F.count_if(e).alias("supported"), F.count_if(e & a).alias("extracted"), F.count_if(e & c).alias("exact"),
        F.count_if(~e & clean).alias("clean_cases"), F.count_if(~e & clean & a).alias("false_positives"), F.count_if(e & ~a).alias("false_negatives"),
        F.count_if(e & a & ~c).alias("incorrect_payloads"), F.count_if(~e & ~clean & a).alias("unsupported_detected"),
    )
    return counts.select("*", percentage(F.col("extracted"), F.col("supported")).alias("extraction_rate"), percentage(F.col("false_positives"), F.col("clean_cases")).alias("false_positive_rate"))


def ela_rollup(cases: DataFrame) -> DataFrame:
    """cases (id, known_edit, highlighted_ratio, p95_error): benign cases against the one edited case.

    The edited side is a single row; an evaluation with another number of edits has no result.
    """
    edited = cases.filter("known_edit").agg(F.max("highlighted_ratio").alias("edited_ratio"), F.max("p95_error").alias("edited_p95"), F.count("*").alias("edits")).filter("edits = 1")
    benign = cases.filter("NOT known_edit").crossJoin(edited)  # one row
    return benign.groupBy("edited_ratio", "edited_p95").agg(
        F.count("*").alias("benign"), F.count_if(F.col("highlighted_ratio") > 0).alias("benign_highlighted"),
        F.count_if(F.col("highlighted_ratio") >= F.col("edited_ratio")).alias("benign_ratio_at_least_edited"),
        F.count_if(F.col("p95_error") >= F.col("edited_p95")).alias("benign_p95_at_least_edited"),
        F.max_by("id", F.struct("highlighted_ratio", -F.col("id"))).alias("most_highlighted_benign"),
    )


def study_task_counts(answers: DataFrame) -> DataFrame:
    """answers (participant, task, status) -> each of the tasks with the number of each status; what nobody
    answered is told as zeros. One aggregation over all rows."""
    counts = answers.agg(*[F.count_if((F.col("task") == t) & (F.col("status") == s)).alias(f"{t}_{s}") for t in TASKS for s in STATUSES])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(t).alias("task"), *[F.col(f"{t}_{s}").alias(s) for s in STATUSES]) for t in TASKS])))


def completed(tasks: Column, ratings: Column) -> Column:
    """Whether a participant ran all the tasks and gave every rating."""
    run = ~F.exists(F.map_values(tasks), lambda s: s == "not_run") & (F.size(tasks) > 0)
    return F.coalesce(run & ~F.exists(F.map_values(ratings), lambda v: v.isNull()) & (F.size(ratings) > 0), F.lit(False))


def study_completed(participants: DataFrame) -> DataFrame:
    """participants -> those who ran all tasks and gave all ratings, with their comments."""
    return participants.filter(completed(F.col("tasks"), F.col("ratings"))).select("id", "most_confusing", "recommended_change")


def study_comments(participants: DataFrame) -> DataFrame:
    """id, question, comment: what completed participants wrote, but for blank comments."""
    both = F.inline(F.array(*[F.struct(F.lit(c).alias("question"), F.col(c).alias("comment")) for c in ("most_confusing", "recommended_change")]))
    return study_completed(participants).select("id", both).filter(F.trim(F.coalesce("comment", F.lit(""))) != "")


def study_summary(participants: DataFrame, required: int = 5) -> DataFrame:
    """One row: how many participants are complete, whether that is all that are required (only then may results be
    told), and the numbers of comments, statuses by task, and responses with means by rating. One aggregation over all rows."""
    done = completed(F.col("tasks"), F.col("ratings"))
    told = lambda c: F.count_if(done & (F.trim(F.coalesce(c, F.lit(""))) != ""))
    status = lambda t, s: F.count_if(F.element_at("tasks", t) == s)
    n = participants.agg(
        F.count_if(done).alias("completed_participants"), told("most_confusing").alias("most_confusing_comments"), told("recommended_change").alias("recommended_changes"),
        F.array(*[F.struct(F.lit(t).alias("task"), *[status(t, s).alias(s) for s in STATUSES]) for t in TASKS]).alias("task_results"),
        F.array(*[F.struct(F.lit(r).alias("rating"), F.count(F.element_at("ratings", r)).alias("responses"), F.round(F.avg(F.element_at("ratings", r)), 2).alias("mean")) for r in RATINGS]).alias("rating_results"),
    )
    complete = F.col("completed_participants") == required
    return n.select(complete.alias("study_complete"), complete.alias("publishable"), F.lit(required).cast("long").alias("required_participants"), "*")


STUDY_KEYS, PARTICIPANT_KEYS = ("schema_version", "task", "participants"), ("id", "tasks", "ratings", "most_confusing", "recommended_change")


def study_document_errors(documents: DataFrame) -> DataFrame:
    """documents (path, text: a study as JSON) -> path, errors: keys that are missing or too many, at the top and
    in each participant, a wrong version, and ids that are blank or stand twice."""
    top = F.from_json("text", "map<string,string>")
    people = F.from_json(F.element_at("top", "participants"), "array<map<string,string>>")
    listed = documents.select("path", top.alias("top")).select("path", "top", F.coalesce(people, F.array().cast("array<map<string,string>>")).alias("people"))
    names = lambda c, wanted, where: [
        F.when(F.size(apart) > 0, F.concat(where, F.lit(f" {what}: "), F.array_join(F.array_sort(apart), ",")))
        for what, apart in (("lacks", F.array_except(F.array(*map(F.lit, wanted)), F.map_keys(c))), ("has unexpected", F.array_except(F.map_keys(c), F.array(*map(F.lit, wanted)))))
    ]
    ids = F.transform("people", lambda p: F.trim(F.coalesce(F.element_at(p, "id"), F.lit(""))))
    each = F.flatten(F.transform("people", lambda p, i: F.array(*names(p, PARTICIPANT_KEYS, F.concat(F.lit("participant "), (i + 1).cast("string"))))))
    general = F.array(
        F.when(F.col("top").isNull(), "not a JSON object"), *names(F.col("top"), STUDY_KEYS, F.lit("document")), F.when(F.coalesce(F.element_at("top", "schema_version"), F.lit("")) != "1", "schema_version must be 1"),
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), "participant ids must differ"), F.when(F.array_contains(ids, ""), "participant ids must not be blank"),
    )
    return listed.select("path", F.array_compact(F.concat(general, each)).alias("errors"))


def study_ratings(ratings: DataFrame) -> DataFrame:
    """ratings (participant, rating, value) -> responses and mean of the given values."""
    return ratings.groupBy("rating").agg(F.count("value").alias("responses"), F.avg("value").alias("mean"))


def study_errors(participants: DataFrame) -> DataFrame:
    """participants (id, tasks map, ratings map, most_confusing, recommended_change) -> id, all its errors."""
    keys = lambda c, names: F.array_sort(F.map_keys(c)) == F.array(*[F.lit(n) for n in sorted(names)])
    prefix = lambda text: F.concat(F.col("id"), F.lit(": "), text)
    invalid = F.array_sort(F.array_distinct(F.filter(F.map_values("tasks"), lambda v: ~v.isin(*STATUSES))))
    found = [
        F.when(~F.coalesce(keys(F.col("tasks"), TASKS), F.lit(False)), prefix(F.lit("tasks are not the five asked for"))).when(F.size(invalid) > 0, prefix(F.concat(F.lit("unknown statuses: "), F.array_join(invalid, ",")))),
        F.when(~F.coalesce(keys(F.col("ratings"), RATINGS), F.lit(False)), prefix(F.lit("ratings are not the three asked for"))),
        *[F.when(~F.coalesce(F.element_at("ratings", r).between(1, 5), F.lit(True)), prefix(F.lit(f"{r} lies outside 1..5"))) for r in RATINGS],
        *[F.when(F.coalesce(F.char_length(f) > 500, F.lit(True)), prefix(F.lit(f"{f} is missing or over 500 characters"))) for f in ("most_confusing", "recommended_change")],
    ]
    return participants.select("id", F.array_compact(F.array(*found)).alias("errors"))
