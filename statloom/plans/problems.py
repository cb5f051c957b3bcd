"""The pN_ queries of the general problems (1 and 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators.nested import inline_shared, plan_tables, schema_graph, shred, table_of
from statloom.operators.snapshots import snapshot_changes, validity_intervals
from statloom.operators.statute_nodes import REPEATABLE, statute_nodes
from statloom.tables import load


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches = load(spark, sf_dir, "raw_legal_data").select(F.col("id").alias("record_id"), F.col("content").alias("payload"))
    documents = load(spark, sf_dir, "legal_documents").select(F.col("document_id").alias("record_id"), F.col("raw_data").alias("payload"))
    return searches.unionAll(documents)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the payloads with the link to its record and its parent."""
    return statute_nodes(_payloads(spark, sf_dir), "record_id", "payload")


def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of all flat tables, with their keys and those of their parent rows."""
    payloads = _payloads(spark, sf_dir)
    nodes = shred(payloads, "record_id", "payload", plan_tables(schema_graph(payloads, "payload")))
    return nodes.select("record_id", "table_name", "node_id", "parent_table", "parent_id", _json_of("attrs").alias("attrs")).distinct()


def _json_of(attrs: str) -> Column:
    """A map as JSON, by name, so that its order decides nothing."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attrs))))


# Element and columns of each flat table.
FLAT_TABLES = {
    "p1_laws": ("law", ["법령ID", "법령일련번호", "법령명한글", "공포일자", "시행일자"]),
    "p1_containers": ("조문", ["조문번호", "조문가지번호", "조문제목", "조문내용"]),
    "p1_articles": ("조문단위", ["조문번호", "조문가지번호", "조문제목", "조문내용"]),
    "p1_paragraphs": ("항", ["항번호", "항내용"]),
    "p1_items": ("호", ["호번호", "호내용"]),
    "p1_subitems": ("목", ["목번호", "목내용"]),
    "p1_cited_statutes": ("referencedStatuteIds[]", ["content"]),
}


def _flat_table(name: str):
    element, columns = FLAT_TABLES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, nodes = inline_shared(_payloads(spark, sf_dir), "record_id", "payload", {*columns, "referencedStatuteIds"}, REPEATABLE)
        return table_of(nodes, element, columns).distinct()

    query.__doc__ = f"The flat table of {element}: its columns, its key and that of its parent row."
    return query


_SNAPSHOT_COLUMNS = ("source", "snapshot_no", "document_id", "updated_at", ["title", "content"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each source added, removed or changed from one of its deliveries to its next."""
    changes = snapshot_changes(load(spark, sf_dir, "legal_document_snapshots"), *_SNAPSHOT_COLUMNS)
    return changes.select("source", "snapshot_no", F.col("key").alias("document_id"), "change_kind")


def p2_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries from and to which each version of a document was valid."""
    intervals = validity_intervals(load(spark, sf_dir, "legal_document_snapshots"), *_SNAPSHOT_COLUMNS)
    return intervals.select("source", F.col("key").alias("document_id"), "valid_from", "valid_to")


QUERIES = {"p1_found": p1_found, "p1_tables": p1_tables, "p2_found": p2_found, "p2_intervals": p2_intervals} | {name: _flat_table(name) for name in FLAT_TABLES}

_P2_CURRENT = """
WITH rows_of AS (
  SELECT source, snapshot_no, document_id, title, content,
         row_number() OVER (PARTITION BY source, snapshot_no, document_id ORDER BY updated_at DESC NULLS LAST) AS rn
  FROM legal_document_snapshots),
deliveries AS (
  SELECT source, snapshot_no, row_number() OVER w AS delivery, lead(snapshot_no) OVER w AS next_no,
         lag(snapshot_no) OVER w AS previous_no
  FROM (SELECT DISTINCT source, snapshot_no FROM legal_document_snapshots)
  WINDOW w AS (PARTITION BY source ORDER BY snapshot_no)),
current_rows AS (
  SELECT r.source, r.snapshot_no, r.document_id, r.title, r.content, d.delivery, d.next_no, d.previous_no
  FROM rows_of r JOIN deliveries d
    ON r.source IS NOT DISTINCT FROM d.source AND r.snapshot_no = d.snapshot_no
  WHERE r.rn = 1)
"""



def _objects(value: str) -> str:
    """SQL: the objects that stand at a member, as a list."""
    return f"CASE json_type({value}) WHEN 'ARRAY' THEN list_filter(json_extract({value}, '$[*]'), lambda x: json_type(x) = 'OBJECT') WHEN 'OBJECT' THEN [{value}] ELSE [] END"


def scalar_sql(value: str) -> str:
    """SQL: a value, or the content of a wrapped one; null if it is empty."""
    return f"nullif(trim(CASE json_type({value}) WHEN 'OBJECT' THEN json_extract_string({value}, '$.content') ELSE json_extract_string({value}, '$') END), '')"


def _unwrapped(table: str) -> str:
    return f"SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(json_extract_string(j, '$')) THEN json_extract_string(j, '$')::JSON ELSE j END AS j FROM {table}"


#: DuckDB's side of problem 1: payloads, search items and articles.
NODES_SQL = f"""
WITH payloads AS (SELECT id AS record_id, content AS p FROM raw_legal_data UNION ALL SELECT document_id, raw_data FROM legal_documents),
once AS (SELECT record_id, CASE WHEN json_valid(p) THEN p::JSON END AS j FROM payloads WHERE json_valid(p)),
twice AS ({_unwrapped("once")}), thrice AS ({_unwrapped("twice")}),
laws AS (SELECT record_id, {_objects("json_extract(j, '$.LawSearch.law')")} AS list FROM thrice),
law AS (SELECT record_id, i - 1 AS position, list[i] AS item FROM (SELECT *, unnest(range(1, len(list) + 1)) AS i FROM laws)),
roots AS (SELECT record_id, CASE WHEN json_type(j, '$.법령') = 'OBJECT' THEN json_extract(j, '$.법령') ELSE j END AS r FROM thrice),
articles AS (SELECT record_id, CASE WHEN json_type(r, '$.조문') = 'OBJECT' AND json_exists(r, '$.조문.조문단위') THEN {_objects("json_extract(r, '$.조문.조문단위')")}
                                    ELSE {_objects("json_extract(r, '$.조문')")} END AS list FROM roots),
article AS (SELECT record_id, (i - 1)::VARCHAR AS path, list[i] AS item FROM (SELECT *, unnest(range(1, len(list) + 1)) AS i FROM articles))"""
_LEVEL = """,
{name} AS (SELECT record_id, up AS parent, up || '.' || (i - 1) AS path, list[i] AS item FROM (
  SELECT *, unnest(range(1, len(list) + 1)) AS i FROM (SELECT record_id, path AS up, {objects} AS list FROM {above})))"""
for _name, _above, _member in (("paragraph", "article", "항"), ("item", "paragraph", "호"), ("subitem", "item", "목")):
    NODES_SQL += _LEVEL.format(name=_name, above=_above, objects=_objects(f"json_extract(item, '$.{_member}')"))
_BRANCH = scalar_sql("json_extract(item, '$.조문가지번호')")
_STRIPPED = "regexp_replace({}, '^0+(.)', '\\1')"  # one zero of zeros alone stays

#: DuckDB's side of shared inlining: all elements with their ancestors, the tables that follow, and their rows.


def _inlined_sql(declared: frozenset[str]) -> str:
    always = "false" if not declared else "key IN (" + ", ".join(f"'{x}'" for x in sorted(declared)) + ")"
    is_node = f"json_type(x) = 'OBJECT' AND ({always} OR NOT (len(json_keys(x)) = 1 AND coalesce(json_type(x, '$.content') NOT IN ('OBJECT', 'ARRAY', 'NULL'), false)))"
    known = "false" if not declared else "e.name IN (" + ", ".join(f"'{x}'" for x in sorted(declared)) + ")"
    return NODES_SQL[: NODES_SQL.index(",\nlaws AS")].replace("WITH payloads", "WITH RECURSIVE payloads") + f""",
element AS (
  SELECT record_id, '$' AS name, ['$'] AS names, ['$:0'] AS paths, '' AS parent, false AS listed, j AS v FROM thrice WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT record_id, key, list_append(names, key), list_append(paths, paths[-1] || '/' || key || ':' || (i - 1)), name, listed, nodes[i] FROM (
    SELECT *, unnest(range(1, len(nodes) + 1)) AS i FROM (
      SELECT record_id, name, names, paths, key, json_type(m) = 'ARRAY' AS listed, list_filter(CASE json_type(m) WHEN 'ARRAY' THEN json_extract(m, '$[*]') ELSE [m] END, lambda x: {is_node}) AS nodes
      FROM (SELECT *, json_extract(v, '$."' || key || '"') AS m FROM (SELECT *, unnest(json_keys(v)) AS key FROM element)) WHERE json_type(m) IN ('OBJECT', 'ARRAY')))),
tables AS (SELECT e.name FROM element e GROUP BY e.name HAVING e.name = '$' OR bool_or(e.listed) OR count(DISTINCT e.parent) > 1 OR {known}),
table_names AS (SELECT list(name) AS t FROM tables),
located AS (SELECT e.*, list_filter(range(1, len(names) + 1), lambda i: list_contains(t, names[i])) AS spots FROM element e, table_names),
entry AS (SELECT record_id, names, paths, spots, key, json_extract(v, '$."' || key || '"') AS m FROM (SELECT *, unnest(json_keys(v)) AS key FROM located)),
scalar AS (
  SELECT record_id, paths[spots[-1]] AS node_id, list_aggregate(list_append(names[spots[-1] + 1:], key), 'string_agg', '.') AS name,
         CASE json_type(m) WHEN 'OBJECT' THEN json_extract_string(m, '$.content') ELSE json_extract_string(m, '$') END AS value
  FROM entry WHERE json_type(m) NOT IN ('OBJECT', 'ARRAY', 'NULL') OR (json_type(m) = 'OBJECT' AND json_type(m, '$.content') NOT IN ('OBJECT', 'ARRAY', 'NULL'))),
repeated_scalar AS (
  SELECT record_id, key || '[]' AS table_name, paths[-1] || '/' || key || '[]:' || (i - 1) AS node_id, names[spots[-1]] AS parent_table, paths[spots[-1]] AS parent_id,
         CASE json_type(xs[i]) WHEN 'OBJECT' THEN json_extract_string(xs[i], '$.content') ELSE json_extract_string(xs[i], '$') END AS value
  FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT *, json_extract(m, '$[*]') AS xs FROM entry WHERE json_type(m) = 'ARRAY'))
  WHERE json_type(xs[i]) NOT IN ('OBJECT', 'ARRAY', 'NULL') OR (json_type(xs[i]) = 'OBJECT' AND NOT ({is_node.replace("(x", "(xs[i]")}))),
flat AS (SELECT record_id, name AS table_name, paths[-1] AS node_id, CASE WHEN len(spots) > 1 THEN names[spots[-2]] END AS parent_table, CASE WHEN len(spots) > 1 THEN paths[spots[-2]] END AS parent_id
         FROM located WHERE spots[-1] = len(names))"""


def _flat_sql(name: str) -> str:
    element, columns = FLAT_TABLES[name]
    if element.endswith("[]"):
        return _inlined_sql(REPEATABLE) + f" SELECT DISTINCT record_id, node_id, parent_table, parent_id, value AS content FROM repeated_scalar WHERE table_name = '{element}'"
    values = ", ".join(f"max(CASE WHEN name = '{c}' THEN value END) AS \"{c}\"" for c in columns)
    return (
        _inlined_sql(REPEATABLE)
        + f""" SELECT DISTINCT f.record_id, f.node_id, parent_table, parent_id, {", ".join(f'"{c}"' for c in columns)}
FROM flat f LEFT JOIN (SELECT record_id, node_id, {values} FROM scalar GROUP BY ALL) s ON s.record_id = f.record_id AND s.node_id = f.node_id WHERE table_name = '{element}'"""
    )


ORACLE_SQL = {
    "p1_tables": _inlined_sql(frozenset())
    + """, attrs AS (SELECT record_id, node_id, '{' || string_agg(to_json(name)::VARCHAR || ':' || to_json(value)::VARCHAR, ',' ORDER BY name) || '}' AS attrs
          FROM (SELECT DISTINCT record_id, node_id, name, value FROM scalar) GROUP BY ALL)
SELECT DISTINCT f.*, coalesce(attrs, '{}') AS attrs FROM flat f LEFT JOIN attrs a ON a.record_id = f.record_id AND a.node_id = f.node_id
UNION SELECT record_id, table_name, node_id, parent_table, parent_id, '{"content":' || to_json(value)::VARCHAR || '}' FROM repeated_scalar
""",
    **{name: _flat_sql(name) for name in FLAT_TABLES},
    "p1_found": NODES_SQL
    + f"""
SELECT DISTINCT record_id, 'law' AS node_level, position::VARCHAR AS node_path, '' AS parent_path,
  coalesce({scalar_sql("json_extract(item, '$.법령ID')")}, {scalar_sql("json_extract(item, '$.법령일련번호')")}, '') AS node_key FROM law
UNION SELECT record_id, 'article', path, '', coalesce({_STRIPPED.format(scalar_sql("json_extract(item, '$.조문번호')"))}, '')
  || CASE WHEN regexp_replace({_BRANCH}, '^0+', '') <> '' THEN '-' || regexp_replace({_BRANCH}, '^0+', '') ELSE '' END FROM article
UNION SELECT record_id, 'paragraph', path, parent, '' FROM paragraph
UNION SELECT record_id, 'item', path, parent, '' FROM item
UNION SELECT record_id, 'subitem', path, parent, '' FROM subitem
""",
    "p2_found": _P2_CURRENT
    + """
SELECT n.source, n.snapshot_no, n.document_id, CASE WHEN o.delivery IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM current_rows n LEFT JOIN current_rows o
  ON n.source IS NOT DISTINCT FROM o.source AND n.document_id IS NOT DISTINCT FROM o.document_id
 AND o.delivery = n.delivery - 1
WHERE n.delivery > 1 AND (o.delivery IS NULL OR n.title IS DISTINCT FROM o.title OR n.content IS DISTINCT FROM o.content)
UNION ALL
SELECT o.source, o.next_no, o.document_id, 'removed'
FROM current_rows o LEFT JOIN current_rows n
  ON n.source IS NOT DISTINCT FROM o.source AND n.document_id IS NOT DISTINCT FROM o.document_id
 AND n.delivery = o.delivery + 1
WHERE o.next_no IS NOT NULL AND n.delivery IS NULL
""",
    "p2_intervals": _P2_CURRENT
    + """
, marked AS (
  SELECT *, CASE WHEN lag(delivery) OVER w = delivery - 1
              AND lag(title) OVER w IS NOT DISTINCT FROM title
              AND lag(content) OVER w IS NOT DISTINCT FROM content THEN 0 ELSE 1 END AS starts
  FROM current_rows WINDOW w AS (PARTITION BY source, document_id ORDER BY delivery)),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY source, document_id ORDER BY delivery) AS island FROM marked)
SELECT source, document_id, min(snapshot_no) AS valid_from, max(snapshot_no) AS valid_to
FROM numbered GROUP BY source, document_id, island
""",
}
