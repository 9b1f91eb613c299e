"""Checks that a database would enforce as constraints, as reports of violations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.sources.schemas import FOREIGN_KEYS, MONEY_COLUMNS, PRIMARY_KEYS, ROW_KEYS, WIDTHS
from mercadia.sources.shop import Shop


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _union_or_empty(frames: list[DataFrame], shop: Shop, schema: str) -> DataFrame:
    """The union; no rows where a shop has none of the tables that a report is about."""
    if frames:
        return _union(frames)
    return next(iter(shop.tables().values())).sparkSession.createDataFrame([], schema)


def key_violations(df: DataFrame, *key: str) -> DataFrame:
    """Keys that are NULL, in any part, or occur more than once."""
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    unset = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
    return counted.filter(unset | (F.col("rows") > 1))


def key_report(shop: Shop) -> DataFrame:
    """Per table: broken primary keys and the rows they cover."""
    return _union(
        [
            key_violations(df, PRIMARY_KEYS[name]).agg(
                F.lit(name).alias("table_name"),
                F.count(F.lit(1)).alias("bad_keys"),
                F.coalesce(F.sum("rows"), F.lit(0)).alias("bad_rows"),
            )
            for name, df in shop.tables().items()
        ]
    )


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Referenced keys without a parent row, with their number of child rows.

    Child rows are counted per key first, so a key that most rows share joins once.
    """
    counted = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return counted.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def stored_keys(store: DataFrame, key: str | Sequence[str], wanted: DataFrame) -> DataFrame:
    """Those of the wanted keys that a stored table holds, read from the store.

    Only stored rows between the least and the greatest wanted key are read. The same bounds on
    the wanted keys let Spark build a Bloom filter of them at run time, which drops other stored
    keys at the scan, before they are shuffled.
    """
    names = [key] if isinstance(key, str) else list(key)
    bounds = wanted.agg(F.min(names[0]).alias("low"), F.max(names[0]).alias("high")).first()
    inside = F.col(names[0]).between(F.lit(bounds["low"]), F.lit(bounds["high"]))
    found = store.select(*names).filter(inside).join(wanted.select(*names).filter(inside), names, "left_semi")
    return found.distinct()


def _parents(tables: dict[str, DataFrame], stored: dict[str, DataFrame], reference: tuple[str, str, str, str]) -> DataFrame:
    """Keys that a child may refer to: those of its own batch and those already stored."""
    child, column, parent, key = reference
    own = [tables[parent].select(key)] if parent in tables else []
    if parent in stored:
        wanted = tables[child].select(F.col(column).alias(key)).filter(F.col(key).isNotNull())
        own.append(stored_keys(stored[parent], key, wanted))
    return _union(own)


def orphan_report(shop: Shop, stored: Shop | None = None) -> DataFrame:
    """Per foreign key: dangling keys and the rows they cover; parents may be in the store already."""
    tables, known = shop.tables(), stored.tables() if stored else {}
    reports = [
        orphans(tables[child], column, _parents(tables, known, (child, column, parent, key)), key).agg(
            F.lit(f"{child}.{column}").alias("reference"),
            F.count(F.lit(1)).alias("orphan_keys"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"),
        )
        for child, column, parent, key in FOREIGN_KEYS
        if child in tables and (parent in tables or parent in known)
    ]
    return _union_or_empty(reports, shop, "reference string, orphan_keys long, orphan_rows long")


def duplicate_report(shop: Shop, stored: Shop) -> DataFrame:
    """Per table: rows whose key the store already holds."""
    known = stored.tables()
    reports = []
    for name, df in shop.tables().items():
        if name in known:
            key = list(ROW_KEYS[name])
            rows = df.join(stored_keys(known[name], key, df), key, "left_semi")
            reports.append(rows.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("stored_rows")))
    return _union_or_empty(reports, shop, "table_name string, stored_rows long")


def _with_parent(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference is NULL or exists."""
    found = child.join(parent.select(F.col(key).alias("_parent")), F.col(column) == F.col("_parent"), "left_semi")
    return found.unionByName(child.filter(F.col(column).isNull()))


def cascade(shop: Shop) -> Shop:
    """Drop rows whose parent is missing, parents first, as cascading deletes would."""
    kept = shop.tables()
    for child, column, parent, key in FOREIGN_KEYS:
        if child in kept and parent in kept:
            kept[child] = _with_parent(kept[child], column, kept[parent], key)
    return Shop(**kept)


def score_violations(reviews: DataFrame) -> DataFrame:
    """Reviews with a score outside 1 to 5; NULL is allowed."""
    return reviews.filter(~F.col("review_score").between(1, 5))


def _too_wide(name: str, width: int) -> Column:
    return F.count(F.when(F.length(F.col(name).cast("string")) > width, 1))


def _not_money(name: str) -> Column:
    fits = F.col(name).try_cast("decimal(10,2)")
    return F.count(F.when(F.col(name).isNotNull() & fits.isNull(), 1))


def width_report(shop: Shop) -> DataFrame:
    """Per column: values longer than declared, or amounts beyond ten digits."""
    reports = []
    for name, df in shop.tables().items():
        checks = {c: _too_wide(c, w) for c, w in WIDTHS[name].items()} if name in WIDTHS else {}
        checks |= {c: _not_money(c) for c in MONEY_COLUMNS.get(name, ())}
        wide = df.agg(*(check.alias(c) for c, check in checks.items()))
        long = wide.withColumn("table_name", F.lit(name)).unpivot(
            "table_name", list(checks), "column_name", "violations"
        )
        reports.append(long)
    return _union_or_empty(reports, shop, "table_name string, column_name string, violations long")


def violations(shop: Shop, stored: Shop | None = None) -> DataFrame:
    """Broken rules with the rows they concern; empty when the tables are sound.

    Items are identified by order and line, since a line number alone repeats. With ``stored``
    tables, keys must be new to them and parents may be among them.
    """
    tables = shop.tables()
    reports = [
        key_violations(df, *ROW_KEYS[name]).agg(
            F.lit(f"key of {name}").alias("rule"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")
        )
        for name, df in tables.items()
    ]
    reference, place = F.col("reference"), F.concat_ws(".", "table_name", "column_name")
    reports += [
        orphan_report(shop, stored).select(F.concat(F.lit("parent of "), reference).alias("rule"), "orphan_rows"),
        width_report(shop).select(F.concat(F.lit("size of "), place).alias("rule"), "violations"),
    ]
    if stored is not None:
        twice = duplicate_report(shop, stored)
        reports.append(twice.select(F.concat(F.lit("stored key of "), "table_name").alias("rule"), "stored_rows"))
    if "reviews" in tables:
        scores = score_violations(tables["reviews"])
        reports.append(scores.agg(F.lit("range of reviews.review_score").alias("rule"), F.count(F.lit(1))))
    return _union([r.toDF("rule", "rows") for r in reports]).filter(F.col("rows") > 0)


def require_sound(shop: Shop, stored: Shop | None = None) -> None:
    """Raise with the list of broken rules, as a database would on load."""
    broken = violations(shop, stored).collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['rows']} rows" for r in broken))
