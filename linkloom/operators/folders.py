"""Folders: categories by words and hosts, trees under size limits, learning from existing folders, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text, urls
from . import ranges
from .tagging import occurring


def category_scores(full_text: Column, domain: Column, folder: Column) -> Column:
    """Array of (name, score, subcategory) in the dictionary's order. Words count as substrings."""
    said = F.struct(F.lower(full_text).alias("low"), F.lower(F.coalesce(folder, F.lit(""))).alias("held"), domain.alias("domain"))
    return text.bound(said, lambda x: _scored(x["low"], x["held"], x["domain"]))


def _scored(low: Column, held: Column, domain: Column) -> Column:
    words = lambda ws: F.array(*[F.lit(w) for w in ws])
    subs = lambda spec: F.array(*[F.struct(F.lit(-i).alias("at"), F.lit(sub).alias("name"), words(ws).alias("words")) for i, (sub, ws) in enumerate(spec["subcategories"].items())])
    listed = F.array(*[F.struct(F.lit(name).alias("name"), words(spec["keywords"]).alias("keywords"), words(spec["domains"]).alias("domains"), subs(spec).alias("subs")) for name, spec in D.FOLDER_CATEGORIES.items()])
    hits = lambda ws: F.size(F.filter(ws, lambda w: F.contains(low, w)))

    def scored(c: Column) -> Column:
        counted = F.transform(c["subs"], lambda s: F.struct(hits(s["words"]).alias("hits"), s["at"].alias("at"), s["name"].alias("name")))
        named = F.when((held != "") & F.contains(held, F.lower(c["name"])), 3).otherwise(0)
        return F.struct(c["name"].alias("name"), (hits(c["keywords"]) * 2 + F.when(F.array_contains(c["domains"], domain), 5).otherwise(0) + named).alias("score"), counted.alias("counted"))

    def told(c: Column) -> Column:
        best = F.array_max(c["counted"])
        total = F.aggregate(c["counted"], F.lit(0), lambda n, s: n + s["hits"])
        return F.struct(c["name"].alias("name"), (c["score"] + total).alias("score"), F.when(best["hits"] > 0, best["name"]).otherwise("General").alias("subcategory"))

    return F.transform(F.transform(listed, scored), told)


def fallback(folder: Column) -> Column:
    """The category that the first folder part names, else the part itself if its length is reasonable, else Uncategorized."""
    first = text.strip(F.element_at(F.split(F.coalesce(folder, F.lit("")), "/"), 1))
    low = F.lower(first)
    out = F.when(F.length(first).between(3, 29), F.initcap(first)).otherwise("Uncategorized")
    for name in reversed(D.FOLDER_CATEGORIES):
        out = F.when((first != "") & (F.lit(name.lower()).contains(low) | low.contains(name.lower())), name).otherwise(out)
    return out


def categorised(rows: DataFrame, body: str | None = None, hint: str = "folder") -> DataFrame:
    """Adds category and subcategory: the first category with the greatest score, else the fallback."""
    said = F.concat_ws(" ", "title", "note", "url", *([body] if body else []))
    out = rows.withColumn("_scores", category_scores(said, urls.domain(F.col("url")), F.col(hint)))
    best = F.array_max(F.transform("_scores", lambda s, i: F.struct(s["score"].alias("score"), (-i).alias("at"), s["name"].alias("name"), s["subcategory"].alias("sub"))))
    out = out.withColumn("_best", best)
    sure = F.col("_best.score") > 0
    return out.withColumns({"category": F.when(sure, F.col("_best.name")).otherwise(fallback(F.col(hint))), "subcategory": F.when(sure, F.col("_best.sub")).otherwise("General")}).drop("_scores", "_best")


#: Positions of a folder that one task ranks.
SLICE = 50_000


def filed(rows: DataFrame, most: int = 20, pos: str = "pos") -> DataFrame:
    """Adds ``path`` from category and subcategory under a limit of rows per folder.

    Subfolders appear where a category has several subcategories or more rows than the limit. A folder beyond
    the limit is split by the hosts' main labels (groups under three rows are Other); where that leaves no group within the
    limit, or one group only, into parts of ``most`` rows by position. A group by label that is beyond the limit has one label, so it is split
    into parts: two steps reach the end, whatever the sizes. Sizes are aggregates; only slices of a folder are ranked in one task.
    """
    own, by = rows.columns, ["category", "subcategory", "_label"]
    labelled = rows.withColumn("_label", urls.main_label(F.col("url")))
    # One row per category, subcategory and label decides where their rows go.
    counts = labelled.groupBy(*by).agg(F.count("*").alias("_n"))
    kinds = counts.groupBy("category").agg(F.sum("_n").alias("_all"), F.count_distinct("subcategory").alias("_subs"))
    deep = (F.col("_subs") > 1) | (F.col("_all") > most)
    labels = counts.join(kinds, "category").withColumn("path", F.when(deep, F.concat_ws("/", "category", "subcategory")).otherwise(F.col("category")))
    labels = labels.withColumn("_group", F.when(F.col("_n") < 3, "Other").otherwise(F.col("_label")))
    groups = labels.groupBy("path", "_group").agg(F.sum("_n").alias("_g"))
    sizes = groups.groupBy("path").agg(F.sum("_g").alias("_size"), F.min("_g").alias("_least"), F.count("*").alias("_groups"))
    fits, stuck = F.col("_size") <= most, (F.col("_least") > most) | (F.col("_groups") == 1)
    told = labels.join(groups, ["path", "_group"]).join(sizes, "path").select(
        *by, F.when(fits | stuck, F.col("path")).otherwise(F.concat_ws("/", "path", "_group")).alias("_folder"), (~fits & (stuck | (F.col("_g") > most))).alias("_parts")
    )
    placed = labelled.join(told, by)
    ranked = ranges.ranked(placed.where("_parts"), ["_folder"], F.floor(F.col(pos) / SLICE), [pos])
    part = F.concat(F.col("_folder"), F.lit("/Part "), (F.floor((F.col("_rank") - 1) / most) + 1).cast("string"))
    return placed.where("NOT _parts").select(*own, F.col("_folder").alias("path")).unionByName(ranked.select(*own, part.alias("path")))


def prefixes(path: Column) -> Column:
    """a/b/c as [a, a/b, a/b/c]."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def tree(rows: DataFrame, path: str = "path") -> DataFrame:
    """(path, depth, own, total): rows in a folder and in it with all below; inner folders included."""
    nodes = rows.where(F.col(path) != "").select(F.col(path).alias("leaf"), F.explode(prefixes(F.col(path))).alias("path"))
    return nodes.groupBy("path").agg(F.count_if(F.col("leaf") == F.col("path")).alias("own"), F.count("*").alias("total")).withColumn("depth", F.size(F.split("path", "/")))


def cut_depth(path: Column, depth: int) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def learned(rows: DataFrame, least: int = 2) -> DataFrame:
    """(domain, folder, hits): the top folder that most rows of a host have, ties by name, with enough rows."""
    top = F.element_at(F.split("folder", "/"), 1)
    seen = rows.where(F.coalesce("folder", F.lit("")) != "").groupBy(urls.domain(F.col("url")).alias("domain"), top.alias("top")).agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
    best = seen.groupBy("domain").agg(F.min(F.struct((-F.col("hits")).alias("n"), "top")).alias("b"))
    return best.select("domain", F.col("b.top").alias("folder"), (-F.col("b.n")).alias("hits"))


def learned_words(rows: DataFrame, least: int = 2) -> DataFrame:
    """(word, folder, hits): the top folder that most rows with a word have, ties by name, with enough rows. Words are title words over three letters, and tags."""
    top = F.element_at(F.split("folder", "/"), 1)
    words = F.array_distinct(F.concat(F.filter(F.split(F.lower(F.trim(F.coalesce("title", F.lit("")))), r"\s+"), lambda w: F.length(w) > 3), F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)))
    seen = rows.where(F.coalesce("folder", F.lit("")) != "").select(top.alias("top"), F.explode(words).alias("word")).groupBy("word", "top").agg(F.count("*").alias("hits"))
    best = seen.groupBy("word").agg(F.min(F.struct((-F.col("hits")).alias("n"), "top")).alias("b")).select("word", F.col("b.top").alias("folder"), (-F.col("b.n")).alias("hits"))
    return best.where(F.col("hits") >= least)


def learned_category(rows: DataFrame, words: DataFrame, least: int = 2, pos: str = "pos") -> DataFrame:
    """(pos, folder): the learned folder of which a row's title and tags hold at least two words, as substrings; most hits first, ties by name."""
    said = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    found = occurring(rows.select(F.col(pos).alias("url"), said.alias("said"), F.lit(1.0).alias("points")), words.select(F.col("word").alias("tag")))
    hits = found.join(words.select(F.col("word").alias("tag"), "folder"), "tag").groupBy("url", "folder").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return hits.groupBy("url").agg(F.min(F.struct((-F.col("n")).alias("n"), "folder")).alias("b")).select(F.col("url").alias(pos), "b.folder")


def confidence(suggested: Column, original: Column, knows_domain: Column, category: Column) -> Column:
    top = lambda c: F.element_at(F.split(c, "/"), 1)
    same = F.when(F.lower(top(suggested)) == F.lower(top(original)), 0.25).when(F.lower(suggested).contains(F.lower(original)) & (original != ""), 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + same + F.when(knows_domain, 0.2).otherwise(0.0) + F.when(top(suggested) == category, 0.1).otherwise(0.0))


def suggested(rows: DataFrame) -> DataFrame:
    """Adds the folder that a row's host was filed under elsewhere, else its category path, with a confidence."""
    known = learned(rows).select("domain", F.col("folder").alias("known"))
    out = categorised(rows).withColumn("domain", urls.domain(F.col("url"))).join(known, "domain", "left")
    path = F.coalesce("known", F.when(F.col("subcategory") == "General", F.col("category")).otherwise(F.concat_ws("/", "category", "subcategory")))
    out = out.withColumn("suggested", path)
    return out.withColumn("confidence", F.round(confidence(F.col("suggested"), F.coalesce("folder", F.lit("")), F.col("known").isNotNull(), F.col("category")), 6)).drop("known")


def reasoning(category: Column, subcategory: Column, domain: Column, original: Column) -> Column:
    """Why a row was filed as it was, in words."""
    known = F.lit(False)
    for name, spec in D.FOLDER_CATEGORIES.items():
        known = known | ((category == name) & domain.isin(*spec["domains"]))
    return F.concat_ws(
        "; ",
        F.concat(F.lit("category: "), category),
        F.when(subcategory != "General", F.concat(F.lit("subcategory: "), subcategory)),
        F.when(known, F.concat(F.lit("known host: "), domain)),
        F.when(F.coalesce(original, F.lit("")) != "", F.concat(F.lit("was in: "), original)),
    )


def preserved(rows: DataFrame, depth: int = 3) -> DataFrame:
    """Paths from the existing folders, cut to a depth; rows without one are Uncategorized."""
    return rows.withColumn("path", F.coalesce(F.nullif(cut_depth(F.coalesce("folder", F.lit("")), depth), F.lit("")), F.lit("Uncategorized")))
