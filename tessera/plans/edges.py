"""Edges from source text: parts are rendered as modules of eight shapes, which patterns parse and imports resolve.

Shapes by number of the part: a module import with an alias, an import of a name with an alias, methods that call each other, calls within a module, a name that several modules define, a definition of
such a name with a nested function, calls that nothing defines among broken lines, and a dotted module import with an asynchronous method.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import resolve as N
from tessera.plans.code import rendered, rendered_sql
from tessera.sources.tables import table

Q: dict = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


#: ``a`` is the number of a library module, ``b`` of a group of parts that share a name.
SHAPES = [
    "import lib.mod_{a} as m\n\n\ndef run_{k}():\n    return m.helper_{a}(1)",
    "from lib.mod_{a} import helper_{a} as h\n\n\ndef use_{k}(x):\n    y = h(x)  # not_a_call(x)\n    return y",
    "class Box{k}:\n    def get(self):\n        return self.make({size})\n\n    def make(self, n):\n        return other.missing(n)\n\n\nBox{k}()",
    "def local_{k}():\n    return 1\n\n\ndef outer_{k}():\n    if local_{k}():\n        return local_{k}()",
    "def ask_{k}():\n    return shared_{b}({k})",
    "@cached\ndef shared_{b}(n):\n    def inner(x):\n        return x\n    return inner(n)",
    "def broken_{k}(:\n    return nowhere_{k}(\n}\nimport\n\ndef after_{k}():\n    absent_{k}()",
    "import lib.mod_{a}\nfrom lib.nothing import gone\n\n\nclass Job{k}(Base):\n    async def load(self):\n        gone()\n        return await fetch_{a}(self)\n\n\ndef fetch_{a}(j):\n    return j",
]
LIBRARY = "def helper_{a}(x):\n    return x\n\n\ndef fetch_{a}(x):\n    return helper_{a}(x)"
SOURCES = f"""
WITH p AS (SELECT p_partkey AS k, p_partkey % 7 AS a, p_partkey // 80 AS b, p_size AS size FROM part),
src AS (SELECT 'app.m' || k AS module, CASE k % 8 {' '.join(f'WHEN {i} THEN {rendered_sql(t)}' for i, t in enumerate(SHAPES))} END AS source FROM p
  UNION ALL SELECT DISTINCT 'lib.mod_' || a, {rendered_sql(LIBRARY)} FROM p)"""


def sources(spark, sf) -> DataFrame:
    """(module, source) of a module a part and of the library modules that they import."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part", "p_partkey", "p_size").select(k.alias("k"), (k % 7).alias("a"), F.floor(k / 80).alias("b"), F.col("p_size").alias("size"))
    text = F.when(F.lit(False), "")
    for i, t in enumerate(SHAPES):
        text = text.when(F.col("k") % 8 == i, rendered(t))
    own = p.select(F.concat(F.lit("app.m"), F.col("k").cast("string")).alias("module"), text.alias("source"))
    return own.unionByName(p.select(F.concat(F.lit("lib.mod_"), F.col("a").cast("string")).alias("module"), rendered(LIBRARY).alias("source")).distinct())


_SKIP = ", ".join(f"'{x}'" for x in N.SKIPPED)
FACTS = SOURCES + f""", ln AS (SELECT module, generate_subscripts(string_split(source, chr(10)), 1) AS n, unnest(string_split(source, chr(10))) AS line FROM src),
w AS (SELECT *, regexp_extract(line, '{N.DEFINITION}', 2) AS kind, regexp_extract(line, '{N.DEFINITION}', 3) AS name, regexp_matches(line, '^[^\\s#)\\]}}]') AS top FROM ln),
b AS (SELECT *, last_value(CASE WHEN top THEN n END IGNORE NULLS) OVER o AS t, last_value(CASE WHEN top OR kind = 'def' THEN n END IGNORE NULLS) OVER o AS i FROM w WINDOW o AS (PARTITION BY module ORDER BY n)),
f AS (SELECT b.module, b.n, b.line, b.kind, b.name, b.top, CASE WHEN t.kind = 'class' THEN t.name ELSE '' END AS cls, CASE WHEN t.kind = 'class' AND i.n > t.n THEN i.name WHEN t.kind = 'def' THEN t.name ELSE '' END AS fn
  FROM b LEFT JOIN w t ON t.module = b.module AND t.n = b.t LEFT JOIN w i ON i.module = b.module AND i.n = b.i),
d AS (SELECT DISTINCT module, CASE WHEN top THEN '' ELSE cls END AS cls, name FROM f WHERE kind <> '' AND (top OR cls <> '')),
im AS (SELECT DISTINCT module, coalesce(nullif(regexp_extract(line, '{N.IMPORT}', 2), ''), regexp_extract(line, '{N.IMPORT}', 1)) AS alias, regexp_extract(line, '{N.IMPORT}', 1) AS target, NULL::VARCHAR AS name FROM f WHERE regexp_matches(line, '{N.IMPORT}')
  UNION SELECT DISTINCT module, coalesce(nullif(regexp_extract(line, '{N.FROM}', 3), ''), regexp_extract(line, '{N.FROM}', 2)), regexp_extract(line, '{N.FROM}', 1), regexp_extract(line, '{N.FROM}', 2) FROM f WHERE regexp_matches(line, '{N.FROM}')),
bd AS (SELECT module, cls, fn, regexp_replace(regexp_replace(line, '{N.DEFINITION}\\s*\\(?', ''), '#.*$', '') AS body FROM f),
cl AS (SELECT DISTINCT module, cls, fn, coalesce(qualifier, '') AS qualifier, name FROM (SELECT module, cls, fn, unnest(regexp_extract_all(body, '{N.CALL}', 1)) AS qualifier, unnest(regexp_extract_all(body, '{N.CALL}', 2)) AS name FROM bd) WHERE name NOT IN ({_SKIP}))"""


@q("import_edges", FACTS + " SELECT DISTINCT im.module, im.target, im.target IN (SELECT module FROM src) AS inside FROM im")
def import_edges(spark, sf):
    """IMPORTS edges between modules."""
    s = sources(spark, sf)
    return N.import_edges(N.lines(s), s)


@q("resolved_calls", FACTS + """, x AS (SELECT *, CASE WHEN qualifier <> '' THEN qualifier || '.' || name ELSE name END AS called, CASE WHEN qualifier = '' THEN '' WHEN qualifier = 'self' THEN cls END AS oc FROM cl),
own AS (SELECT x.*, d.module AS dm, d.cls AS dc, d.name AS dn FROM x JOIN d ON d.module = x.module AND d.cls = x.oc AND d.name = x.name),
brought AS (SELECT x.*, d.module AS dm, d.cls AS dc, d.name AS dn FROM x JOIN im ON im.module = x.module AND im.alias = CASE WHEN x.qualifier = '' THEN x.name ELSE x.qualifier END AND (x.qualifier = '') = (im.name IS NOT NULL)
  JOIN d ON d.module = im.target AND d.cls = '' AND d.name = coalesce(im.name, x.name) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.module = x.module AND own.cls = x.cls AND own.fn = x.fn AND own.called = x.called)),
rest AS (SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.module = x.module AND o.cls = x.cls AND o.fn = x.fn AND o.called = x.called) AND NOT EXISTS (SELECT 1 FROM brought o WHERE o.module = x.module AND o.cls = x.cls AND o.fn = x.fn AND o.called = x.called))
SELECT DISTINCT module, cls, fn, called, dm AS callee_module, dc AS callee_cls, dn AS callee, 'own' AS how FROM own UNION ALL SELECT DISTINCT module, cls, fn, called, dm, dc, dn, 'import' FROM brought
UNION ALL SELECT DISTINCT rest.module, rest.cls, rest.fn, called, d.module, d.cls, d.name, CASE WHEN d.name IS NULL THEN 'unresolved' ELSE 'project' END FROM rest LEFT JOIN d ON d.name = rest.name""")
def resolved_calls(spark, sf):
    """CALLS edges: resolved in the class, the module, through imports, by name in the project, or not at all."""
    return N.call_edges(N.lines(sources(spark, sf)))
