"""The workload generator: a tree of packages from a recipe, as a table of files, its totals, its contract, its files."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.columns import lines, render, safe_name
from ..operators.paths import ancestors
from ..schemas import RECIPE

# The words that packages are called by, in turn.
PACKAGE_WORDS = ("runtime", "helpers", "schema", "config", "types", "router", "builder", "plugin")


class Recipe:
    """A recipe's fields and the texts of its templates."""

    def __init__(self, spark: SparkSession, path: str):
        if not os.path.isfile(path):
            raise ConfigError(f"no such recipe: {path}")
        self.path = path
        self.fields = spark.read.schema(RECIPE).json(path, multiLine=True).first().asDict(recursive=True)
        folder = os.path.dirname(os.path.abspath(path))
        self.templates = {}
        for t in [*self.fields["root_templates"], *self.fields["package_templates"]]:
            try:
                with open(os.path.join(folder, t["template"]), encoding="utf-8") as f:
                    self.templates[t["template"]] = f.read()
            except OSError as e:
                raise ConfigError(f"template {t['template']}: {e.strerror}") from e
        self.check()

    def check(self) -> None:
        f, c = self.fields, self.fields["expected_contract"]
        for wrong, what in (
            (not c["package_count"], "the contract needs a package"), (c["max_package_depth"] < 2, "the contract needs nested packages"), (not c["min_directory_count"], "the contract needs a least number of directories"),
            (not f["scopes"], "the recipe needs a scope"), (not f["root_templates"] or not f["package_templates"], "the recipe needs templates for the root and for packages"),
        ):
            if wrong:
                raise ConfigError(what)


def package_name(index: Column, period: int, scopes: list[str]) -> Column:
    """The name of the package of an index from 0: a word and the index from 1; every period-th has a scope before it."""
    word = F.element_at(F.array(*[F.lit(w) for w in PACKAGE_WORDS]), (index % len(PACKAGE_WORDS) + 1).cast("int"))
    plain = F.format_string("%s-%05d", word, index + 1)
    if period <= 0:
        return plain
    scope = F.element_at(F.array(*[F.lit(s) for s in scopes]), (index % len(scopes) + 1).cast("int"))
    return F.when((index + 1) % period == 0, F.concat(scope, F.lit("/"), plain)).otherwise(plain)


def packages(spark: SparkSession, roots: int, fanout: list[int], period: int, scopes: list[str]) -> DataFrame:
    """index, depth (from 1), name, relative_dir and dependency_names (its children's) of every package. Indices run level
    by level: the i-th child of the p-th package of a level is number p * fanout + i of the next."""
    def name(i: Column) -> Column:
        return package_name(i, period, scopes)

    folder = lambda n: F.concat(F.lit("node_modules/"), n)
    level = spark.range(roots).select("id", F.col("id").alias("index"), F.lit(1).alias("depth"), folder(name(F.col("id"))).alias("relative_dir"))
    every, base, count = [], 0, roots
    for depth, n in enumerate([*fanout, 0], 1):
        first = base + count  # of the next level
        begin = F.lit(first) + F.col("id") * n
        kids = F.transform(F.sequence(begin, begin + n - 1), name) if n else F.array().cast("array<string>")
        every.append(level.select("index", "depth", name(F.col("index")).alias("name"), "relative_dir", kids.alias("dependency_names")))
        if n:
            child = level.select("relative_dir", (F.col("id") * n).alias("__p"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__i"))
            number = F.col("__p") + F.col("__i")
            level = child.select(number.alias("id"), (F.lit(first) + number).alias("index"), F.lit(depth + 1).alias("depth"), F.concat("relative_dir", F.lit("/"), folder(name(F.lit(first) + number))).alias("relative_dir"))
        base, count = first, count * n
    out = every[0]
    for e in every[1:]:
        out = out.unionAll(e)
    return out


def json_entries(names: str | Column, indent: int = 4) -> Column:
    return lines(names, lambda x, i: F.concat(F.lit(" " * indent + '"'), x, F.lit('": "1.0.0"')), last=",")


def context() -> dict[str, Column]:
    """What a package's templates are filled with. The wording of the entries."""
    d = F.col("dependency_names")
    return {
        "PACKAGE_NAME": F.col("name"), "PACKAGE_SAFE_NAME": safe_name("name"), "PACKAGE_VERSION": F.format_string("1.%d.0", F.col("index") % 9 + 1), "PACKAGE_DEPTH": F.col("depth").cast("string"),
        "PACKAGE_INDEX": (F.col("index") + 1).cast("string"), "DEPENDENCY_COUNT": F.size(d).cast("string"),
        "DEPENDENCY_LIST": F.when(F.size(d) == 0, "- (leaf package)").otherwise(lines(d, lambda x, i: F.concat(F.lit("- `"), x, F.lit("`")))),
        "DEPENDENCY_NAME_ARRAY": lines(d, lambda x, i: F.concat(F.lit('"'), x, F.lit('"')), joint=", "), "DEPENDENCIES_JSON": json_entries(d),
        "IMPORT_BLOCK": lines(d, lambda x, i: F.concat(F.lit("import * as dep_"), i.cast("string"), F.lit(' from "'), x, F.lit('";'))),
        "SCHEMA_PROPERTIES": lines(d, lambda x, i: F.concat(F.lit('    "dependency_'), i.cast("string"), F.lit('": { "type": "string", "default": "'), x, F.lit('" }')), last=","),
    }


def files(spark: SparkSession, recipe: Recipe) -> DataFrame:
    """path and content of every file of the workload."""
    f = recipe.fields
    plan = packages(spark, f["root_packages"], f["fanout_per_depth"], f["scoped_package_period"], f["scopes"])
    templates = spark.createDataFrame([(t["relative_path"], recipe.templates[t["template"]]) for t in f["package_templates"]], "__file string, __template string")
    own = plan.crossJoin(F.broadcast(templates)).select(F.concat("relative_dir", F.lit("/"), "__file").alias("path"), render("__template", context()).alias("content"))  # a recipe's few templates
    names = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(f["root_packages"] - 1)), lambda i: package_name(i, f["scoped_package_period"], f["scopes"])).alias("names"))
    roots = spark.createDataFrame([(t["relative_path"], recipe.templates[t["template"]]) for t in f["root_templates"]], "path string, __template string")
    top = roots.join(names, F.lit(True)).select("path", render("__template", {"ROOT_PACKAGE_NAME": F.lit(f["root_package_name"]), "ROOT_DEPENDENCIES_JSON": json_entries("names")}).alias("content"))
    return top.unionAll(own)


def planned_summary(spark: SparkSession, recipe: Recipe) -> DataFrame:
    """One row: packages, files, directories (the root included), bytes and depth that the recipe leads to."""
    f = recipe.fields
    every = files(spark, recipe)
    totals = every.agg(F.count("*").alias("regular_file_count"), F.sum(F.octet_length("content")).alias("total_bytes"))
    plan = packages(spark, f["root_packages"], f["fanout_per_depth"], f["scoped_package_period"], f["scopes"]).agg(F.count("*").alias("package_count"), F.max("depth").alias("max_package_depth"))
    folders = ancestors(every).agg(F.count("*").alias("directory_count"))
    return totals.join(plan, F.lit(True)).join(folders, F.lit(True)).select(  # one row each
        F.lit(f["name"]).alias("name"), F.lit(recipe.path).alias("recipe_path"), "package_count", "regular_file_count", "directory_count", "total_bytes", "max_package_depth",
        F.array(*[F.lit(x) for x in f["expected_contract"]["dominant_file_types"]]).alias("dominant_file_types"),
    )


def broken_terms(summary: DataFrame, contract: dict) -> DataFrame:
    """The terms of a contract that a summary doesn't keep: term, expected, found."""
    terms = {"package_count": "=", "regular_file_count": "=", "max_package_depth": "=", "directory_count": ">="}
    wanted = {**contract, "directory_count": contract["min_directory_count"]}
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(wanted[t]).cast("long").alias("expected"), F.col(t).cast("long").alias("found"), (F.col(t) == wanted[t] if op == "=" else F.col(t) >= wanted[t]).alias("kept")) for t, op in terms.items()])
    return summary.select(F.explode(rows).alias("t")).select("t.*").where(~F.col("kept")).drop("kept")


def materialise(spark: SparkSession, recipe: Recipe, root: str) -> int:
    """Writes the workload's files below root, which must not exist or be empty; returns how many."""
    if os.path.isdir(root) and os.listdir(root):
        raise ConfigError(f"{root} isn't empty")
    os.makedirs(root, exist_ok=True)
    base = os.path.abspath(root)

    def write(rows):
        for r in rows:
            path = os.path.join(base, r["path"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(r["content"])

    every = files(spark, recipe)
    every.foreachPartition(write)
    return every.count()


def summary_json(summary: DataFrame) -> str:
    return json.dumps(json.loads(summary.select(F.to_json(F.struct("*"))).first()[0]), indent=2)
