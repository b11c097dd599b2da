"""Package manifests: npm, pip, pyproject and Maven, as rows (name, version, type, source).

Inputs are rows with a ``content`` column, or lines; everything is evaluated by
built-in functions, a file at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import lines_of
from lodestrata.plans import rules


def npm_packages(files: DataFrame) -> DataFrame:
    """Dependencies of package.json files (content); a malformed file has none."""
    kinds = {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer"}
    parsed = files.select(F.from_json("content", ", ".join(f"{k} map<string,string>" for k in kinds)).alias("j"))
    parts = [parsed.select(F.explode(f"j.{k}").alias("name", "version")).select("name", "version", F.lit(kind).alias("type"), F.lit("package.json").alias("source")) for k, kind in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def _separated(text: Column, separators: list[str]) -> tuple[Column, Column]:
    """Name and the rest around the first separator, by order of the list."""
    name = rest = None
    for s in separators:
        cut = F.substring_index(text, s, 1)
        after = F.substr(text, F.char_length(cut) + F.lit(len(s) + 1))
        name = (F if name is None else name).when(text.contains(s), F.trim(cut))
        rest = (F if rest is None else rest).when(text.contains(s), F.trim(after))
    return name.otherwise(F.trim(F.substring_index(text, "[", 1))), rest


def requirement_lines(lines: DataFrame) -> DataFrame:
    """Packages of requirements lines (line); comments and options have none."""
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = lines.withColumn("__t", text).filter((F.col("__t") != "") & ~F.col("__t").startswith("#") & ~F.col("__t").startswith("-"))
    name, rest = _separated(F.col("__t"), rules.REQUIREMENT_SEPARATORS)
    return rows.withColumns({"name": name, "version": F.substring_index(rest, ",", 1), "type": F.lit("runtime"), "source": F.lit("requirements.txt")}).drop("__t")


def requirements(files: DataFrame) -> DataFrame:
    return requirement_lines(files.select(F.explode(lines_of(F.col("content"))).alias("line"))).select("name", "version", "type", "source")


def pyproject(files: DataFrame) -> DataFrame:
    """Dependency lines of pyproject.toml files; a fold over the lines holds the section."""
    line = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def step(acc: Column, raw: Column) -> Column:
        s = line(raw)
        runtime = s.startswith("[project.dependencies]") | s.startswith("dependencies = [")
        dev = F.lower(s).contains("dev") & s.startswith("[")
        other = s.startswith("[") & ~s.startswith("[[")
        state = F.when(runtime, "runtime").when(dev, "dev").when(other, "").otherwise(acc["state"])
        clean = F.regexp_replace(s, r'^[",\[\] ]+|[",\[\] ]+$', "")
        keep = ~(runtime | dev | other) & (acc["state"] != "") & (clean != "") & ~clean.startswith("#")
        return F.struct(state.alias("state"), F.when(keep, F.concat(acc["rows"], F.array(F.struct(clean.alias("t"), acc["state"].alias("type"))))).otherwise(acc["rows"]).alias("rows"))

    start = F.struct(F.lit("").alias("state"), F.array().cast("array<struct<t:string,type:string>>").alias("rows"))
    rows = files.select(F.explode(F.aggregate(lines_of(F.col("content")), start, step)["rows"]).alias("r")).select("r.t", "r.type")
    name, rest = _separated(F.col("t"), [s for s in [">=", "==", "~=", "<=", ">", "<"]])
    out = rows.select(name.alias("name"), F.regexp_replace(rest, '[",]+$', "").alias("version"), "type", F.lit("pyproject.toml").alias("source"))
    return out.filter((F.col("name") != "") & ~F.col("name").startswith("{"))


def maven(files: DataFrame) -> DataFrame:
    """Dependency blocks of pom.xml files."""
    block = r"<dependency>\s*<groupId>[^<]+</groupId>\s*<artifactId>[^<]+</artifactId>\s*(?:<version>[^<]+</version>)?"
    rows = files.select(F.explode(F.regexp_extract_all("content", F.lit(block), F.lit(0))).alias("b"))
    tag = lambda t: F.regexp_extract("b", f"<{t}>([^<]+)</{t}>", 1)
    return rows.select(F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"), F.nullif(tag("version"), F.lit("")).alias("version"), F.lit("runtime").alias("type"), F.lit("pom.xml").alias("source"))


def packages(files: DataFrame) -> DataFrame:
    """All packages of files (path, content), by the files' names."""
    base = F.element_at(F.split("path", "/"), -1)
    of = lambda n: files.filter(base == n)
    return reduce(DataFrame.unionByName, [npm_packages(of("package.json")), requirements(of("requirements.txt")), pyproject(of("pyproject.toml")), maven(of("pom.xml"))])
