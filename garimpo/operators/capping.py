"""At most ``cap`` postings per search group, each link owned by one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from garimpo import runtime
from garimpo.operators.dedupe import keep_first, nulls_last
from garimpo.operators.ranking import position_in_group


def limit_cap(df: DataFrame, cap: int, group: str = "search_group", order: str = "collect_seq") -> DataFrame:
    """First ``cap`` rows of each group by the integer ``order``, then by link.

    Rows are numbered block by block, and blocks that begin beyond the cap are dropped
    before anything is numbered: no task holds a whole group, whatever the cap. A NULL
    group is a group, a NULL order comes last in its group, in the order of a hash of the link.
    """
    placed = position_in_group(df, F.col(group), order, "_position", "job_link", upto=cap)
    return placed.filter(F.col("_position") <= cap).select(*df.columns)


def own_group(df: DataFrame, group: str = "search_group", order: str = "collect_seq") -> DataFrame:
    """Each link once, in the earliest group that lists it."""
    return keep_first(df, {"key_link": F.col("job_link")}, F.struct(*nulls_last(group), *nulls_last(order)))


def cap_per_group(df: DataFrame, cap: int, group: str = "search_group",
                  order: str = "collect_seq") -> DataFrame:
    """Single pass: a link counts only in its earliest group, then the cap applies.

    Differs from the greedy form only where a cap cuts a link that a later group
    lists as well; see :func:`cap_per_group_greedy`.
    """
    return limit_cap(own_group(df, group, order), cap, group, order)


def cap_per_group_greedy(df: DataFrame, cap: int, group: str = "search_group",
                         order: str = "collect_seq") -> DataFrame:
    """Exact sequential form: groups in turn, links accepted earlier are skipped.

    The groups are those of the data, a NULL one last. All are cut together first, as if no
    link were shared. A later round cuts only the groups that list a link whose owner, the
    earliest group that accepts it, has come to lie before them or no longer does; the search
    ends when there is none. After n rounds the first n groups are final, and the groups to
    cut become fewer as fewer owners change; what the others accepted, `cap` rows each at
    most, is passed on.
    """
    spark = df.sparkSession
    listed = keep_first(
        df, {"key_group": F.col(group), "key_link": F.col("job_link")}, F.struct(*nulls_last(order))
    )
    listed = runtime.stage(listed, "listed")
    place, link = F.struct(*nulls_last(group)), F.col("job_link")
    accepted = runtime.stage(limit_cap(listed, cap, group, order), "cut")
    owners = _owners(accepted, place)
    # nobody owned anything before the first round
    changed = owners.select("_link", F.lit(None).cast(owners.schema["_owner"].dataType).alias("_before"), "_owner")
    while True:
        hit = listed.join(changed, link.eqNullSafe(F.col("_link")))
        ahead = [F.coalesce(F.col(c) < place, F.lit(False)) for c in ("_before", "_owner")]
        groups = runtime.stage(hit.filter(ahead[0] != ahead[1]).select(F.col(group).alias("_again")).distinct(), "groups")
        if groups.isEmpty():
            return accepted
        again = F.col(group).eqNullSafe(F.col("_again"))
        open_ = listed.join(groups, again, "left_semi").join(owners, link.eqNullSafe(F.col("_link")), "left")
        # an owner of this group itself stands for no earlier one
        open_ = open_.filter(F.col("_owner").isNull() | (place <= F.col("_owner"))).select(*listed.columns)
        cut = limit_cap(open_, cap, group, order)
        accepted = runtime.stage(accepted.join(groups, again, "left_anti").unionByName(cut), "accepted")
        new = _owners(accepted, place)
        changed = new.join(owners.select(F.col("_link").alias("_old"), F.col("_owner").alias("_before")), F.col("_link").eqNullSafe(F.col("_old")), "full")
        changed = changed.filter(~F.col("_owner").eqNullSafe(F.col("_before"))).select(F.coalesce("_link", "_old").alias("_link"), "_before", "_owner")
        owners = new


def _owners(accepted: DataFrame, place: Column) -> DataFrame:
    return runtime.stage(accepted.groupBy(F.col("job_link").alias("_link")).agg(F.min(place).alias("_owner")), "owners")
