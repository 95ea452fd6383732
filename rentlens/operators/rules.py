"""Suitability rules: a rule names the rows it turns away and says why.

Rules compile to one CASE expression, so classifying is a single narrow pass.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import moment, whole_days_between
from ..schemas import SQFT_SUFFIX
from .joins import lookup_join
from .listings import with_floor_area, with_monthly_rent


@dataclass(frozen=True)
class Rule:
    """``rejects`` true turns the listing away; false and null let it pass.

    ``error`` is the message for listings on which the rule cannot decide, null for all others.
    """

    name: str
    rejects: Column
    reason: Column
    error: Column | None = None

    def decides(self) -> Column:
        """``rejects``, but failing the query where there is an error."""
        if self.error is None:
            return self.rejects
        return F.when(self.error.isNotNull(), F.raise_error(self.error).cast("boolean")).otherwise(self.rejects)


def rule_residential() -> Rule:
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("commercial", "development", "students", "auction")]
    return Rule("residential", flags[0] | flags[1] | flags[2] | flags[3], F.lit("not a residential letting"))


def rule_has_price() -> Rule:
    return Rule("has_price", F.col("amount").isNull(), F.lit("no price"))


def rule_min_area(min_sqm: int) -> Rule:
    """Listings without a size in square feet pass; one that is not a whole number is an error."""
    reason = F.concat(F.lit("too small: "), F.col("square_feet").cast("string"), F.lit(" sq. ft."))
    # Null where the size can be read.
    error = F.concat(F.lit("size is not a whole number: "), F.col("_size_unread"))
    return Rule("min_area", F.col("square_metres") < min_sqm, reason, error)


def rule_available() -> Rule:
    return Rule("available", F.col("let_agreed"), F.lit("let agreed"))


def rule_max_rent(cap: int | float | str) -> Rule:
    """``cap`` is a number, or the name of a column with a cap per row.

    A monthly rent of zero counts as unknown, hence as above any cap. An unknown frequency is
    an error.
    """
    limit = F.col(cap) if isinstance(cap, str) else F.lit(cap)
    rent = F.coalesce(F.nullif(F.col("monthly_rent"), F.lit(0.0)), F.lit(float("inf")))
    reason = F.concat(
        F.lit("too expensive: "), F.col("amount").cast("string"), F.lit(" "), F.col("frequency")
    )
    unknown = F.col("amount").isNotNull() & F.col("monthly_rent").isNull()
    message = F.concat(F.lit("unknown price frequency: "), F.coalesce("frequency", F.lit("null")))
    return Rule("max_rent", ~unknown & (rent > limit), reason, F.when(unknown, message))


def rule_recent(now: dt.datetime, max_days: int | None, type_name: str = "timestamp") -> Rule:
    """No limit (None or 0) and listings without a date pass. ``now`` is always given."""
    days = whole_days_between("first_visible_date", now, type_name)
    rejects = F.lit(False)
    if max_days:
        # More than max_days whole days: at least max_days + 1 days ago.
        rejects = F.col("first_visible_date") <= moment(now - dt.timedelta(days=max_days + 1), type_name)
    reason = F.concat(F.lit("added "), days.cast("string"), F.lit(" days ago"))
    return Rule("recent", rejects, reason)


def rule_commute() -> Rule:
    """For rows that carry ``commute_ok`` (see ``commute.commute_ok``)."""
    return Rule("commute", ~F.coalesce(F.col("commute_ok"), F.lit(False)), F.lit("commute too long"))


def _with_inputs(df: DataFrame) -> DataFrame:
    """Derived columns; what cannot be derived is null, and an error only for the rule that needs it."""
    if "monthly_rent" not in df.columns:
        df = with_monthly_rent(df, on_error="null")
    if "square_metres" not in df.columns and "display_size" in df.columns:
        df = with_floor_area(df, on_error="null")
    if "_size_unread" not in df.columns:
        unread = F.lit(None).cast("string")
        if "display_size" in df.columns and "square_feet" in df.columns:
            unread = F.when(F.endswith("display_size", F.lit(SQFT_SUFFIX)) & F.col("square_feet").isNull(), F.col("display_size"))
        df = df.withColumn("_size_unread", unread)
    return df


def classify(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``skip_rule`` and ``skip_reason`` of the first rule that turns a listing away.

    Both are null for accepted listings. Rows classified before keep their verdict, so
    later (dearer) rules can be added after a join.
    """
    df = _with_inputs(df)
    again = "skip_rule" in df.columns
    if not again:
        df = df.withColumns({"skip_rule": F.lit(None).cast("string"), "skip_reason": F.lit(None).cast("string")})
    name, reason = F.when(F.col("skip_rule").isNotNull(), F.col("skip_rule")), F.when(
        F.col("skip_rule").isNotNull(), F.col("skip_reason")
    )
    for rule in rules:
        name, reason = name.when(rule.decides(), rule.name), reason.when(rule.decides(), rule.reason)
    return df.withColumns({"skip_rule": name, "skip_reason": reason}).drop("_size_unread")


def suitable(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The accepted listings.

    Only the verdict is needed, so each rule is a filter of its own and the simple ones
    reach the scan. A listing that some rule turns away is left out before errors are looked
    for; one that would be accepted but for an error fails the query.
    """
    df = _with_inputs(df)
    for rule in rules:
        df = df.where(rule.rejects.isNull() | ~rule.rejects)
    verdict = None
    for rule in rules:
        if rule.error is not None:
            verdict = F.when(rule.decides(), False) if verdict is None else verdict.when(rule.decides(), False)
    if verdict is not None:
        # All rules once more in one expression, so that no error is raised before a filter.
        rejected = F.lit(False)
        for rule in rules:
            rejected = rejected | F.coalesce(rule.rejects, F.lit(False))
        df = df.where(F.when(rejected, False).otherwise(verdict.otherwise(True)))
    return df.drop("_size_unread")


def funnel(classified: DataFrame) -> DataFrame:
    """Listings per verdict: ``outcome`` is the rule's name, or ``accepted``."""
    return classified.groupBy(F.coalesce("skip_rule", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("listings")
    )


def with_price_cap(
    df: DataFrame, caps: DataFrame, default: int, on: str = "name", column: str = "cap"
) -> DataFrame:
    """Add ``cap``: the cap of the row's place, or ``default`` where it has none."""
    return lookup_join(df, caps.select(on, column), on, "left").withColumn(
        column, F.coalesce(F.col(column), F.lit(default))
    )


def exclude_seen(df: DataFrame, history: DataFrame | None, key: str = "id") -> DataFrame:
    """Rows whose id the history does not hold; without a history all rows."""
    return df if history is None else df.join(history.select(key), key, "left_anti")


def drop_let_agreed(ids: DataFrame, history: DataFrame, key: str = "id") -> DataFrame:
    """Ids without those the history holds as let agreed."""
    return ids.join(history.where("let_agreed").select(key), key, "left_anti")
