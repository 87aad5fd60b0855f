"""Even out the sizes of a covering split by exchanges that keep it covering.

An utterance is *bound* to its set if it alone has some triphone there. What
may leave a set is found anew in every round, from counts of the present sets.
Where all utterances of a set that is too large are bound, exchanges free some:
an utterance from another set comes in that has everything for which several
of the set's utterances are bound, and those go out, if need be into the other
set, where they stand in for the one that left. Exchanges that free just one
change no size; a few of them are tried, in seeded order, to get off a plateau.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.operators.frames import SALTS, number_rows, salted_join
from framelark.session import cut_lineage, shuffles_dropped, staged, unstaged

#: Rounds without a smaller excess before the search is given up.
PATIENCE = 12


#: Rows from which on an utterance or a triphone is dealt to several tasks.
HOT = 100_000


def _last_salt():
    return F.when(F.col("n_tri") > HOT, SALTS - 1).otherwise(0)


def placed(kept: DataFrame, rich: DataFrame) -> DataFrame:
    """``kept`` dealt out by utterance and written, so that no round moves it again.

    ``rich`` has ``n_tri`` of each utterance; a hot one goes to several tasks.
    """
    marked = kept.join(F.broadcast(rich.where(F.col("n_tri") > HOT)), "utt", "left")
    salt = F.least(F.pmod(F.xxhash64("triphone"), F.lit(SALTS)).cast("int"), _last_salt())
    conf = kept.sparkSession.conf
    tasks = int(conf.get("spark.sql.shuffle.partitions"))
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")  # else Spark forgets how the rows were dealt out
    try:
        with shuffles_dropped(kept.sparkSession):
            return cut_lineage(marked.select("utt", salt.alias("_salt"), "triphone").repartition(
                tasks, "utt", "_salt").sortWithinPartitions("utt", "_salt"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def indexed(kept: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of ``kept`` with the columns of their utterances; ``placed`` ones stay in place."""
    if "_salt" not in kept.columns:
        return salted_join(kept, sets, ["utt"], spread=F.col("triphone"))
    copies = sets.withColumn("_salt", F.explode(F.sequence(F.lit(0), _last_salt())))
    return kept.join(copies, ["utt", "_salt"]).drop("_salt")


def _moved(sets: DataFrame, moves: DataFrame) -> DataFrame:
    """``sets`` after moves ``(utt, to)``."""
    out = sets.join(moves, "utt", "left")
    return out.withColumn("set_name", F.coalesce("to", "set_name")).drop("to")


def leavers(kept: DataFrame, sets: DataFrame, candidate) -> DataFrame:
    """Candidates that may leave their sets all at once.

    Where every holder of a triphone is a candidate, one stays for it: the one
    with most triphones, so that few have to.
    """
    flagged = sets.withColumn("_c", candidate)
    order = F.struct(-F.col("n_tri"), F.col("draw"), F.col("utt"))
    stay = indexed(kept, flagged).groupBy("set_name", "triphone").agg(
        F.min("_c").alias("all"), F.min(order).alias("w")
    ).where("all").select(F.col("w.utt").alias("utt")).distinct()
    return flagged.where("_c").drop("_c").join(stay, "utt", "left_anti")


def covers(kept: DataFrame, sets: DataFrame, names: list[str]) -> bool:
    n_sets = indexed(kept, sets).groupBy("triphone").agg(
        F.count_distinct("set_name").alias("n")).where(F.col("n") < len(names))
    return n_sets.isEmpty()


def exchanges(kept: DataFrame, sets: DataFrame, crowded: str, held: list) -> DataFrame:
    """``(v, home, u)``: v comes into the crowded set from ``home``, each u can go.

    Every bound utterance of the set is listed with one v at most, the one that
    frees most. If v is bound at home, the u's listed with it have all that v
    alone had there.
    """
    rows = indexed(kept, sets)
    sole = staged(rows.groupBy("set_name", "triphone").agg(
        F.count(F.lit(1)).alias("c"), F.min("utt").alias("owner")
    ).where("c = 1").drop("c"))
    needs = sole.groupBy("set_name", "owner").agg(F.count(F.lit(1)).alias("n_need"))
    here = sole.where(F.col("set_name") == crowded)
    others = rows.where(F.col("set_name") != crowded).select(
        F.col("utt").alias("v"), F.col("set_name").alias("home"), "draw", "triphone")
    if held:
        others = others.where(~F.col("v").isin(held))
    met = salted_join(
        others, here.select("triphone", F.col("owner").alias("u")), ["triphone"], spread=F.col("v"))
    pairs = met.groupBy("v", "home", "draw", "u").agg(F.count(F.lit(1)).alias("n")).join(
        needs.where(F.col("set_name") == crowded).select(
            F.col("owner").alias("u"), F.col("n_need").alias("n")), ["u", "n"]
    ).drop("n")
    gain = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("gain"))
    best = pairs.join(gain, "v").groupBy("u").agg(
        F.max(F.struct("gain", "draw", "v", "home")).alias("b"))
    chosen = staged(best.select(F.col("b.v").alias("v"), F.col("b.home").alias("home"), "u"))
    # What v alone has at home must be among what its u's bring there.
    bound = sole.withColumnsRenamed({"set_name": "home", "owner": "v"})
    brought = chosen.join(kept.withColumnRenamed("utt", "u"), "u").select("v", "home", "triphone").distinct()
    lost = bound.join(chosen.select("v").distinct(), "v", "left_semi").join(
        brought, ["v", "home", "triphone"], "left_anti").select("v").distinct()
    return chosen.join(lost, "v", "left_anti")


def _exchange(kept, sets, crowded: str, turn: int, tried: list) -> tuple[DataFrame | None, bool]:
    """Sets after one exchange and whether it freed more than it brought in."""
    found = staged(exchanges(kept, sets, crowded, tried))
    best = found.groupBy("v", "home").agg(F.count(F.lit(1)).alias("gain")).orderBy(
        F.desc("gain"), F.xxhash64("v", F.lit(turn)), "v").limit(1).collect()
    if not best:
        unstaged(found)
        return None, False
    v, home = best[0]["v"], best[0]["home"]
    tried.append(v)
    freed = found.where(F.col("v") == v).select(F.col("u").alias("utt"), F.lit(True).alias("_f"))
    here = F.when(F.col("utt") == v, crowded).otherwise(F.col("set_name"))
    inside = staged(sets.withColumn("set_name", here).join(freed, "utt", "left").withColumn(
        "_f", F.coalesce("_f", F.lit(False))))
    going = leavers(kept, inside, F.col("_f")).select("utt", F.lit(home).alias("to"))
    after = staged(_moved(inside.drop("_f"), going))
    unstaged(found, inside)
    if not covers(kept, after, [r[0] for r in sets.select("set_name").distinct().collect()]):
        unstaged(after)
        return sets, False
    return after, best[0]["gain"] > 1


def even_out(
    kept: DataFrame, sets: DataFrame, sizes: dict[str, int], buckets: int, max_rounds: int,
) -> DataFrame:
    """Sets of the asked sizes, each as covering as before.

    ``sets`` has ``(utt, n_tri, draw, set_name)``; ``buckets`` is the width of a
    draw's leading digits, along which leaving utterances are numbered.
    """
    best, waited, tried = None, 0, []
    for turn in range(max_rounds):
        present = {r["set_name"]: r["n"] for r in
                   sets.groupBy("set_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        excess = {s: present.get(s, 0) - n for s, n in sizes.items()}
        over = [s for s, e in excess.items() if e > 0]
        if not over:
            return sets
        total = sum(excess[s] for s in over)
        waited = 0 if best is None or total < best else waited + 1
        best = total if best is None else min(best, total)
        if waited > PATIENCE:
            break
        free = staged(leavers(kept, sets, F.col("set_name").isin(over)))  # numbering reads it four times
        bucket = F.floor(F.col("draw") / buckets)
        ranked = number_rows(free, ["set_name"], ["draw", "utt"], bucket, "rank", "bigint")
        leaving = F.coalesce(
            *[F.when((F.col("set_name") == s) & (F.col("rank") < excess[s]), True) for s in over],
            F.lit(False))
        pool = staged(number_rows(
            ranked.where(leaving).drop("rank"), [], ["draw", "utt"], bucket, "rank", "bigint"))
        # The pool is dealt to the sets that lack utterances, in the order of its ranks.
        target, start = F.lit(None).cast("string"), 0
        for s, e in excess.items():
            if e < 0:
                here = (F.col("rank") >= start) & (F.col("rank") < start - e)
                target = F.when(here, s).otherwise(target)
                start -= e
        before, sets = sets, staged(_moved(sets, pool.select("utt", target.alias("to"))))
        n_pool = pool.count()
        unstaged(before, free, pool)
        if n_pool == total:
            return sets
        crowded = max((s for s in over), key=lambda s: excess[s])
        after, freed = _exchange(kept, sets, crowded, turn, tried)
        if after is None and not tried:
            break
        if after is None or freed:
            tried = tried[-1:] if freed else []
        if after is not None and after is not sets:
            unstaged(sets)
            sets = after
    raise RuntimeError(
        f"{best} utterances too many in {'/'.join(over)}: no exchange found that keeps every "
        "triphone covered; raise the limit")
