"""Standard tables of results, and what can be found in nested results by their schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def selection_report(sites: DataFrame, threshold: float = 0.95) -> DataFrame:
    """The eight columns of a site-selection report; calls are strict, positive is asked first, the rest is none."""
    positive, purifying = F.col("p_positive") > threshold, F.col("p_purifying") > threshold
    return sites.select(
        F.col("site").alias("Codon Sites"), F.col("p_positive").alias("P(beta > alpha)"), F.col("p_purifying").alias("P(alpha > beta)"),
        F.col("mean_alpha").alias("mean(alpha)"), F.col("mean_beta").alias("mean(beta)"), positive.alias("positive_selected"), purifying.alias("purifying_selected"),
        F.when(positive, "positive").when(purifying, "purifying").otherwise("none").alias("selection"),
    )


def ratio_report(rows: DataFrame, level: float = 0.05) -> DataFrame:
    """Scalars of a ratio test with its level and calls at or below it; a missing p is no call."""
    at = lambda c: F.coalesce(F.col(c) <= level, F.lit(False))
    return rows.withColumns({"significance_threshold": F.lit(level), "positive_selected_at_threshold": at("p_positive"), "purifying_selected_at_threshold": at("p_purifying")})


def violin_rows(marginals: DataFrame, sites: DataFrame, threshold: float = 0.9, purifying: bool = True, most: int | None = None) -> DataFrame:
    """site, call, alpha, beta: masses by bin of the detected sites, for drawing; ``most`` keeps the first sites only."""
    positive = F.col("p_positive") > threshold
    wanted = positive | (F.lit(purifying) & (F.col("p_purifying") > threshold))
    found = sites.filter(wanted).select("site", F.when(positive, "positive").otherwise("purifying").alias("call"))
    found = found if most is None else found.orderBy("site").limit(most)
    lane = lambda axis: F.transform(F.array_sort(F.collect_list(F.when(F.col("axis") == axis, F.struct("bin", "mass")))), lambda x: x["mass"]).alias(axis)
    return found.join(marginals.groupBy("site").agg(lane("alpha"), lane("beta")), "site")


def plain_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text; arrays and maps of any element type are plain lists and objects, nulls are left in."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))


def nested_tables(df: DataFrame) -> dict[str, DataFrame]:
    """A DataFrame for each array of structs of a nested result, by dotted path: its rows with the scalars of its elements and row, a number from 1."""
    from .reports import flatten_scalars

    out: dict[str, DataFrame] = {}

    def walk(frame: DataFrame, schema: T.StructType, column: Column | None, path: str) -> None:
        for f in schema.fields:
            c, at = (F.col(f"`{f.name}`") if column is None else column.getField(f.name)), f"{path}.{f.name}".lstrip(".")
            if isinstance(f.dataType, T.StructType):
                walk(frame, f.dataType, c, at)
            elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                each = frame.select(F.posexplode(c).alias("row", "_e"))
                out[at] = flatten_scalars(each.select((F.col("row") + 1).alias("row"), "_e.*"))
                walk(each.select("_e"), f.dataType.elementType, F.col("_e"), at)

    walk(df, df.schema, None, "")
    return out


def newick_texts(df: DataFrame) -> DataFrame:
    """label, tree of every string in a nested result that looks like a tree: opened by a parenthesis, closed by a semicolon.

    The label is the dotted path, with numbers from 1 for elements of arrays and keys for maps. Each level of arrays or maps
    is one generator without a shuffle, and only columns that can hold strings are read.
    """
    found: list[DataFrame] = []

    def walk(frame: DataFrame, kind: T.DataType, column: Column, label: Column) -> None:
        join = lambda name: F.when(label == "", name).otherwise(F.concat_ws(".", label, name))
        if isinstance(kind, T.StringType):
            tree = F.trim(column)
            found.append(frame.select(label.alias("label"), tree.alias("tree")).filter(F.col("tree").startswith("(") & F.col("tree").endswith(";") & F.col("tree").contains(")")))
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(frame, f.dataType, column.getField(f.name), join(F.lit(f.name)))
        elif isinstance(kind, T.ArrayType):
            each = frame.select(label.alias("_l"), F.posexplode(column).alias("_i", "_e")).select(F.concat_ws(".", F.nullif("_l", F.lit("")), (F.col("_i") + 1).cast("string")).alias("_l"), "_e")
            walk(each, kind.elementType, F.col("_e"), F.col("_l"))
        elif isinstance(kind, T.MapType):
            each = frame.select(label.alias("_l"), F.explode(column).alias("_k", "_e")).select(F.concat_ws(".", F.nullif("_l", F.lit("")), F.col("_k").cast("string")).alias("_l"), "_e")
            walk(each, kind.valueType, F.col("_e"), F.col("_l"))

    for f in df.schema.fields:
        walk(df, f.dataType, F.col(f"`{f.name}`"), F.lit(f.name))
    if not found:
        return df.sparkSession.createDataFrame([], "label string, tree string")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def restored_names(trees: DataFrame, names: DataFrame) -> DataFrame:
    """tree_id, newick with numbered tips (a number after a parenthesis or comma) given their names back; unknown numbers stay."""
    parts = trees.select("tree_id", F.posexplode(F.expr("regexp_extract_all(newick, '(?:[(,][0-9]+(?=[:,)]))|(?:[^(,]+|[(,])', 0)")).alias("at", "part"))
    number = F.nullif(F.regexp_extract("part", "^[(,]([0-9]+)$", 1), F.lit("")).cast("int")
    joined = parts.withColumn("index", number).join(names, "index", "left")
    text = F.when(F.col("name").isNotNull(), F.concat(F.substring("part", 1, 1), "name")).otherwise(F.col("part"))
    return joined.groupBy("tree_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("t")))), lambda x: x["t"]), "").alias("newick"))


def null_vector(parameters: DataFrame, dropped: str) -> DataFrame:
    """model, position, name, value of the null: an alternative's vector without the dropped parameters, numbered anew."""
    from pyspark.sql import Window

    kept = parameters.filter(F.col("name") != dropped)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("model").orderBy("position")) - 1)


def saved_index(signals: DataFrame) -> DataFrame:
    """dataset, source, method, signals, keys: what a saved run holds, so that tables can be made again without its analysis."""
    return signals.groupBy("dataset", "source", "method").agg(F.array_sort(F.collect_set("metric")).alias("metrics"), F.countDistinct("key").alias("keys"))


def named_moves(moves: DataFrame, taxa: DataFrame) -> DataFrame:
    """moves with index arrays ``moved`` and ``target`` as sorted arrays of names; an index without a name is left out."""
    names = F.broadcast(taxa.agg(F.map_from_entries(F.collect_list(F.struct("index", "name"))).alias("_names")))  # the taxa of one alignment
    label = lambda c: F.array_sort(F.filter(F.transform(c, lambda i: F.try_element_at("_names", i)), lambda x: x.isNotNull())).alias(c)
    return moves.crossJoin(names).select(*[c for c in moves.columns if c not in ("moved", "target")], label("moved"), label("target"))
