"""CALLS and IMPORTS edges from source text: facts by line, then names resolved through imports.

Facts come from patterns over lines, in the JVM: definitions with their class, imports with their alias, calls with their qualifier and the definition that they stand in.  A call is resolved by the
first of these that has a match: a method of its own class (``self.name``), a definition of its own module, an import of the name, a module import of the qualifier, and then every definition of that name in the
project, one edge each.  A call that matches nothing is an edge without a callee.

Names that many modules define are cut over tasks by a salt of the module.  Defined cases: a source that is null has no facts; broken lines that match no pattern are passed over; names of the language itself
(``SKIPPED``) are not calls; equal edges are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import stored

#: Patterns of one line; groups: definition (indent, kind, name), import (module, alias), import of names (module, name, alias), calls (qualifier, name).
DEFINITION = r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)"
IMPORT = r"^\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?\s*$"
FROM = r"^\s*from\s+([\w.]+)\s+import\s+(\w+)(?:\s+as\s+(\w+))?\s*$"
CALL = r"(?:([A-Za-z_]\w*)\.)?([A-Za-z_]\w*)\("
SKIPPED = ("if", "for", "while", "return", "def", "class", "and", "or", "not", "in", "print", "super")
SALTED = 10_000


def lines(sources: DataFrame) -> DataFrame:
    """(module, n, line, cls, fn): each line of ``sources(module, source)`` with the class and the definition that it stands in."""
    d = sources.select("module", F.posexplode(F.split("source", "\n", -1)).alias("n", "line"))
    part = lambda i: F.regexp_extract("line", DEFINITION, i)
    kind, indent, name = part(2), F.length(part(1)), part(3)
    top = F.col("line").rlike(r"^[^\s#)\]}]")
    order = Window.partitionBy("module").orderBy("n")
    # a line at the margin ends what stood before it; a definition at the margin begins the next
    mark = F.when(top & (kind == "class"), F.struct(name.alias("cls"), F.lit("").alias("fn"))).when(top & (kind == "def"), F.struct(F.lit("").alias("cls"), name.alias("fn"))).when(top, F.struct(F.lit("").alias("cls"), F.lit("").alias("fn")))
    block = F.last(mark, ignorenulls=True).over(order)
    inner = F.when(top, F.struct(F.lit("").alias("fn"))).when((kind == "def") & (indent > 0), F.struct(name.alias("fn")))
    d = d.withColumns({"kind": kind, "name": name, "indent": indent, "top": top, "block": block, "inner": F.last(inner, ignorenulls=True).over(order)})
    method = F.when((F.col("block.cls") != "") & (F.col("inner.fn") != ""), F.col("inner.fn"))
    return d.select("module", "n", "line", "kind", "name", "top", F.coalesce("block.cls", F.lit("")).alias("cls"), F.coalesce(method, "block.fn", F.lit("")).alias("fn"))


def definitions(parsed: DataFrame) -> DataFrame:
    """(module, cls, name, kind): functions and classes at the margin (cls is empty) and methods."""
    d = parsed.where((F.col("kind") != "") & (F.col("top") | (F.col("cls") != "")))
    return d.select("module", F.when(F.col("top"), "").otherwise(F.col("cls")).alias("cls"), "name", F.when(~F.col("top"), "method").when(F.col("kind") == "class", "class").otherwise("function").alias("kind")).distinct()


def imports(parsed: DataFrame) -> DataFrame:
    """(module, alias, target, name): name is null for a module import."""
    x = lambda p, i: F.regexp_extract("line", p, i)
    some = lambda c: F.when(c != "", c)
    whole = parsed.where(F.col("line").rlike(IMPORT)).select("module", F.coalesce(some(x(IMPORT, 2)), x(IMPORT, 1)).alias("alias"), x(IMPORT, 1).alias("target"), F.lit(None).cast("string").alias("name"))
    names = parsed.where(F.col("line").rlike(FROM)).select("module", F.coalesce(some(x(FROM, 3)), x(FROM, 2)).alias("alias"), x(FROM, 1).alias("target"), x(FROM, 2).alias("name"))
    return whole.unionByName(names).distinct()


def calls(parsed: DataFrame) -> DataFrame:
    """(module, cls, fn, qualifier, name) of each distinct call."""
    body = F.regexp_replace(F.regexp_replace("line", DEFINITION + r"\s*\(?", ""), r"#.*$", "")
    both = F.arrays_zip(F.regexp_extract_all(body, F.lit(CALL), F.lit(1)).alias("q"), F.regexp_extract_all(body, F.lit(CALL), F.lit(2)).alias("c"))
    c = parsed.select("module", "cls", "fn", F.explode(both).alias("x")).select("module", "cls", "fn", F.coalesce("x.q", F.lit("")).alias("qualifier"), F.col("x.c").alias("name"))
    return c.where(~F.col("name").isin(*SKIPPED)).distinct()


def import_edges(parsed: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, target, inside): each module that a module imports, and whether it is one of ``modules(module)``."""
    i = imports(parsed).select("module", "target").distinct()
    known = modules.select(F.col("module").alias("target"), F.lit(True).alias("inside")).distinct()
    return i.join(known, "target", "left").select("module", "target", F.coalesce("inside", F.lit(False)).alias("inside"))


def dealt(side: DataFrame) -> DataFrame:
    """A side of a join that is shuffled, never broadcast."""
    return side.hint("merge")


def call_edges(parsed: DataFrame) -> DataFrame:
    """(module, cls, fn, called, callee_module, callee_cls, callee, how) of each resolved call and each that is not.

    Facts are stored once, so no join reads the sources again.  They grow with the sources but look small to a planner, which goes by the size of what they are cut from or of
    their packed files; so joins say that no side goes to the driver.
    """
    d, i = stored(definitions(parsed), "definitions"), stored(imports(parsed), "imports-found")
    c = stored(calls(parsed), "calls").withColumn("called", F.when(F.col("qualifier") != "", F.concat("qualifier", F.lit("."), "name")).otherwise(F.col("name")))
    free = F.col("qualifier") == ""
    # own class, own module
    own = d.select("module", F.col("cls").alias("own_cls"), "name", F.lit(True).alias("own"))
    c = c.withColumn("own_cls", F.when(free, "").when(F.col("qualifier") == "self", F.col("cls"))).join(dealt(own), ["module", "own_cls", "name"], "left")
    # through an import: the name of a function, or the qualifier of a module
    by = i.select("module", F.col("alias").alias("key"), "target", F.col("name").alias("imported"), F.col("name").isNull().alias("whole"))
    c = c.withColumn("key", F.when(free, F.col("name")).otherwise(F.col("qualifier"))).join(dealt(by), ["module", "key"], "left")
    fits = F.col("target").isNotNull() & (free != F.col("whole"))
    c = c.withColumns({"to": F.when(fits, F.col("target")), "to_name": F.when(fits, F.coalesce("imported", "name"))})
    there = d.where("cls = ''").select(F.col("module").alias("to"), F.col("name").alias("to_name"), F.lit(True).alias("there"))
    # what no import fits has a key of its own, so such calls spread
    c = c.withColumn("at", F.coalesce("to", F.concat(F.lit("\0"), "module"))).join(dealt(there.withColumnRenamed("to", "at")), ["at", "to_name"], "left")
    key = ["module", "cls", "fn", "called", "name"]
    best = c.groupBy(*key, "own_cls").agg(F.max("own").alias("own"), F.array_distinct(F.collect_list(F.when(F.col("there"), F.struct("to", "to_name")))).alias("found"))
    edge = lambda m, k, n, how: [F.col(x) for x in key[:4]] + [m.alias("callee_module"), k.alias("callee_cls"), n.alias("callee"), F.lit(how).alias("how")]
    mine = best.where("own").select(*edge(F.col("module"), F.col("own_cls"), F.col("name"), "own"))
    rest = best.where("own is null")
    brought = rest.where(F.size("found") > 0).select(*key, F.explode("found").alias("f")).select(*edge(F.col("f.to"), F.lit(""), F.col("f.to_name"), "import"))
    # by name in the whole project; a name of many definitions is cut by a salt
    left = rest.where(F.size("found") == 0)
    many = d.groupBy("name").agg(F.ceil(F.count("*") / SALTED).alias("salts"))
    salted = d.join(dealt(many), "name").select("name", F.pmod(F.xxhash64("module"), F.col("salts")).alias("salt"), F.col("module").alias("dm"), F.col("cls").alias("dc"))
    asked = left.join(dealt(many), "name", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)))
    named = asked.join(dealt(salted), ["name", "salt"]).select(*edge(F.col("dm"), F.col("dc"), F.col("name"), "project"))
    none = left.join(dealt(many), "name", "left_anti").select(*edge(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), "unresolved"))
    return mine.unionByName(brought).unionByName(named).unionByName(none).distinct()
