"""The registered queries, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.match import highlight
from graphloom.functions.ordered import dense_index
from graphloom.functions.urls import parse_repo_url
from graphloom.operators import (
    answers, apiflow, callflow, dedupe, diff, extract, history, incremental, lookup, merge, mutate, plugins,
    responses, search, summary, views,
)
from graphloom.plans.corpus import PROSE_LEXICON, Corpus, with_views
from graphloom.schema import (
    COMMAND_PREFIXES, ENTITY_TYPES, LEXICON, QUESTION_KEYWORDS, RELATION_TYPES, RESPONSE_ENTITY_TYPES,
)
from graphloom.session import checkpoint_dir, cut
from graphloom.sinks import lines as line_sinks
from graphloom.sinks import tables as table_sinks
from graphloom.sinks.store import GraphStore
from graphloom.sources.gitlog import read_git_log
from graphloom.sources.graphs import read_flow, read_graph, read_manifest
from graphloom.sources.tree import as_files, parse_documents, scan_projects, scan_tree
from graphloom.sources.watched import watch_tree
from graphloom.streaming.changes import debounce, debounce_stream, watch_and_update, watch_changes, watch_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = "", name: str | None = None, recursive: bool = False):
    """Register ``fn(corpus)`` under its name, with its checking SQL over the named views."""

    def register(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Corpus(spark, sf_dir))

        QUERIES[key] = run
        if sql is not None:
            head = with_views(*views.split()) if views else ""
            ORACLES[key] = (head.replace("with ", "with recursive ", 1) if recursive else head) + sql
        return fn

    return register


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _terms(lexicon) -> str:
    return _values([(t, k) for k, names in lexicon.items() for t in names])


# First entity per name, as most lookups need it.
FIRST = """
    select project, lower(name) as key, arg_min(name, (kind, pos)) as name, arg_min(type, (kind, pos)) as type,
           arg_min(coalesce(description, chr(0)), (kind, pos)) as d0, arg_min(source_file, (kind, pos)) as source_file
    from ent group by 1, 2
"""


def _ordinal(df: DataFrame) -> DataFrame:
    """Replace ord by the position it came from."""
    return df.withColumn("pos", F.col("ord.pos")).drop("ord")


def _folder(c) -> str:
    """A new folder beside the stored intermediate results."""
    return f"{checkpoint_dir(c.spark).rstrip('/')}/graphloom-{uuid.uuid4().hex}"


# --- sources ----------------------------------------------------------------


@query("select project, name, type, description, source_file, kind, pos from ent", "ent")
def stored_entities(c):
    path = _folder(c)
    table_sinks.write_graph(c.graph(), path)
    return read_graph(c.spark, path).entities.select("project", "name", "type", "description", "source_file", "ord.kind", "ord.pos")


@query("select project, source, target, type, source_file from rel", "rel")
def stored_relations(c):
    path = _folder(c)
    table_sinks.write_graph(c.graph(), path)
    return read_graph(c.spark, path).relations.select("project", "source", "target", "type", "source_file")


@query("select project, name, type, description, source_file from ent", "ent")
def stored_json_entities(c):
    path = _folder(c)
    table_sinks.write_graph(c.graph(), path, "json")
    return read_graph(c.spark, path, "json").entities.select("project", "name", "type", "description", "source_file")


@query("""
    select project, source, target, type, description, source_file, row_number() over (partition by project order by kind, pos) - 1 as place from rel
""", "rel")
def stored_json_relations(c):
    path = _folder(c)
    table_sinks.write_graph(c.graph(), path, "json")
    found = read_graph(c.spark, path, "json").relations
    return found.select("project", "source", "target", "type", "description", "source_file", F.col("ord.pos").alias("place"))


@query("""
    select project, path, md5(content) as content_hash from (
        select project, path, content from md union all select project, path, content from notes) f
""", "md notes")
def stored_manifest(c):
    path = _folder(c)
    table_sinks.write_manifest(incremental.current_manifest(c.files("md", "notes")), path)
    return read_manifest(c.spark, path)


@query("""
    select 'GET' as method, '/orders/' || cast(o_orderkey as varchar) as route, 'order_' || cast(o_orderkey as varchar) as handler from orders
""")
def stored_flow(c):
    path, endpoints = _folder(c), _endpoints(c.files("code"))
    table_sinks.write_flow(endpoints, endpoints.select("project", "handler"), path)
    return c.spark.read.json(f"{path}/api_endpoints").select("method", "route", "handler")


@query("""
    select 'Order' || cast(o_orderkey as varchar) || '.' || name as entry_point, cast(depth as bigint) as depth, step
    from orders, lateral (values
        ('order', 0, 'Order' || cast(o_orderkey as varchar) || '.order_' || cast(o_orderkey as varchar)),
        ('order', 1, 'customer_' || cast(o_custkey as varchar)), ('order', 1, 'status_' || o_orderstatus),
        ('order', 2, 'nation_' || cast((select c_nationkey from customer where c_custkey = o_custkey) as varchar)),
        ('order', 3, 'region_' || cast((select n_regionkey from customer join nation on n_nationkey = c_nationkey where c_custkey = o_custkey) as varchar)),
        ('total', 0, 'Order' || cast(o_orderkey as varchar) || '.total'), ('total', 1, 'Order' || cast(o_orderkey as varchar) || '.price'),
        ('total', 2, 'status_' || o_orderstatus),
        ('price', 0, 'Order' || cast(o_orderkey as varchar) || '.price'), ('price', 1, 'status_' || o_orderstatus)) as m(method, depth, step),
        lateral (select case method when 'order' then 'order_' || cast(o_orderkey as varchar) else method end as name) as n
""")
def stored_chains(c):
    path, files = _folder(c), c.files("code")
    endpoints, index = _endpoints(files), _index(files)
    table_sinks.write_flow(endpoints, callflow.call_chains(index)[1], path)
    return read_flow(c.spark, path)[1].select("entry_point", "depth", "step")


@query('select line, count(*) as "count" from log group by 1', "log")
def stored_log(c):
    path = _folder(c)
    c.log().select("line").write.text(path)
    return read_git_log(c.spark, path).groupBy("line").agg(F.count("*").alias("count"))


def _written_texts(c) -> str:
    """The documents as files of a thousand lines at most, in a folder per source."""
    path = _folder(c)
    lines = c.table("documents").select("source", F.regexp_replace("text", "[\\r\\n]", " ").alias("value"))
    lines.write.option("maxRecordsPerFile", 1000).partitionBy("source").text(path)
    return path


_TEXT_LINES = "select {source} as project, md5(regexp_replace(text, '[\\r\\n]', ' ', 'g')) as line, count(*) as \"count\" from documents group by all"


def _line_counts(files: DataFrame) -> DataFrame:
    rows = files.select("project", F.explode(F.split(F.regexp_replace("content", "\\n$", ""), "\\n")).alias("line"))
    return rows.groupBy("project", F.md5("line").alias("line")).agg(F.count("*").alias("count"))


@query(_TEXT_LINES.format(source="'source=' || source"))
def scanned_projects(c):
    return _line_counts(scan_projects(c.spark, parent=_written_texts(c), extensions=["txt"]))


@query(_TEXT_LINES.format(source="'texts'"))
def scanned_tree(c):
    return _line_counts(scan_tree(c.spark, _written_texts(c), project="texts", extensions=["txt"]))


@query(_TEXT_LINES.format(source="'texts'"))
def watched_tree(c):
    """The same tree as a stream, drained."""
    stream = watch_tree(c.spark, _written_texts(c), _folder(c), project="texts", extensions=["txt"])
    return _line_counts(_drained(c, stream))


@query("""
    select project, path, regexp_extract(content, '^# ([^\\n]*)', 1) as title, count(*) as headings from (
        select project, path, content, unnest(string_split(content, chr(10))) as line
        from (select project, path, content from md union all select project, path, content from notes) f
    ) x where starts_with(line, '#') group by 1, 2, 3
""".replace("\\\\n", "\\n"), "md notes")
def parsed_documents(c):
    docs = parse_documents(c.files("md", "notes"))
    return docs.select("project", "path", "title", F.size("headings").cast("bigint").alias("headings"))


@query("""
    select id, case
        when starts_with(u, 'git@github.com:') then split_part(replace(replace(u, 'git@github.com:', ''), '.git', ''), '/', 1)
        when contains(u, 'github.com') then split_part(split_part(u, 'github.com/', 2), '/', 1)
        when len(string_split(u, '/')) = 2 then split_part(u, '/', 1) end as owner,
      case
        when starts_with(u, 'git@github.com:') then split_part(replace(replace(u, 'git@github.com:', ''), '.git', ''), '/', 2)
        when contains(u, 'github.com') then replace(split_part(split_part(u, 'github.com/', 2), '/', 2), '.git', '')
        when len(string_split(u, '/')) = 2 then split_part(u, '/', 2) end as repo,
      case when starts_with(u, 'git@github.com:') or contains(u, 'github.com') or len(string_split(u, '/')) = 2
        then 'https://github.com/' || owner || '/' || repo end as url
    from (select id, rtrim(trim(url), '/') as u from urls) t
""", "urls")
def parse_url(c):
    return c.view("urls").withColumn("r", parse_repo_url(F.col("url"))).select(
        "id", "r.owner", F.col("r.name").alias("repo"), "r.url"
    )


@query("""
    select project, path, 'Analyze this ' || kind || ' file (' || path || '):' || chr(10) || chr(10)
           || substr(content, part * 8000 + 1, 8000) as message, part, parts
    from (select *, unnest(range(parts))::integer as part from (
        select *, greatest(ceil(length(content) / 8000.0), 1)::integer as parts from (
            select project, path, content, 'document' as kind from notes union all select project, path, content, 'code' from code) f) g) h
""", "notes code")
def prompt_requests(c):
    return responses.prompt_requests(c.files("notes", "code"))


_RESPONSE_SQL = """
    parsed as (select project, path, response::json as j from responses where starts_with(response, '{')),
    es as (select project, parsed.path as path, e.value->>'name' as name, e.value->>'type' as type, e.value->>'description' as description
           from parsed, json_each(j->'entities') as e where e.value->>'type' in """ + _in(RESPONSE_ENTITY_TYPES) + """)
"""


@query(
    ", " + _RESPONSE_SQL + """
    select project, arg_min(name, path) as name, type, arg_min(coalesce(description, '-'), path) as description,
           min(path) as source_file from es group by project, lower(name), type
    """, "responses")
def response_entities(c):
    g = responses.parse_responses(c.view("responses"))
    return g.entities.drop("ord").na.fill("-", ["description"])


@query(
    ", " + _RESPONSE_SQL + """,
    rs as (select project, parsed.path as path, r.value->>'source' as source, r.value->>'target' as target, r.value->>'type' as type
           from parsed, json_each(j->'relations') as r where r.value->>'type' in """ + _in(RELATION_TYPES) + """)
    select project, arg_min(source, path) as source, arg_min(target, path) as target, type, min(path) as source_file
    from rs
    where exists (select 1 from es where es.project = rs.project and es.path = rs.path and lower(es.name) = lower(rs.source))
      and exists (select 1 from es where es.project = rs.project and es.path = rs.path and lower(es.name) = lower(rs.target))
    group by project, lower(source), lower(target), type
    """, "responses")
def response_relations(c):
    g = responses.parse_responses(c.view("responses"))
    return g.relations.drop("ord", "description")


# --- extraction -------------------------------------------------------------


@query(f"""
    select project, type, count(*) as "count" from (
        select distinct project, term, type from notes, (values {_terms(PROSE_LEXICON)}) as lexicon(term, type)
        where contains(lower(content), term)
    ) t group by 1, 2
""", "notes")
def mention_summary(c):
    raw = extract.extract_documents(c.files("notes"), rules=["mention"], lexicon=PROSE_LEXICON)
    entities = dedupe.dedupe_entities(raw.entities)
    return entities.groupBy("project", "type").agg(F.count("*").alias("count"))


_MENTIONS = f"""
    select project, path, term, type from f, (values {_terms(LEXICON)}) as lexicon(term, type)
    where contains(lower(content), term)
"""


@query(f"""
    , f as (select project, path, content from md union all select project, path, content from notes),
    hits as ({_MENTIONS})
    select project, min(path) as source_file, term as name, type from hits group by project, term, type
""", "md notes")
def mention_entities(c):
    raw = extract.extract_documents(c.files("md", "notes"), rules=["mention"])
    return dedupe.dedupe_entities(raw.entities).select("project", "source_file", "name", "type")


@query(f"""
    , f as (select project, path, content from md union all select project, path, content from notes)
    select project, path as source_file, regexp_extract(content, '^# ([^\\n]*)', 1) as source, term as target from ({_MENTIONS}) h
    join f using (project, path)
""", "md notes")
def mention_lookup(c):
    docs = parse_documents(c.files("md", "notes"))
    terms = [(t, k, i) for i, (k, t) in enumerate((k, t) for k, ts in LEXICON.items() for t in ts)]
    lexicon = c.spark.createDataFrame(terms, "term string, type string, pos bigint")
    found = extract.mention_lookup(docs, lexicon)
    return found.relations.select("project", "source_file", "source", "target")


@query("""
    select project, '/parts/' || regexp_extract(path, '([0-9]+)', 1) as name,
           'GET /parts/' || regexp_extract(path, '([0-9]+)', 1) || ' - ' || 'Read part' as description, path as source_file
    from md
""", "md")
def doc_endpoints(c):
    raw = extract.extract_documents(c.files("md", "notes"), rules=["endpoint"])
    return dedupe.dedupe_entities(raw.entities).select("project", "name", "description", "source_file")


@query("""
    select replace(p_brand, '#', '_') as project, 'dataflow build' as name,
           '命令: dataflow build --size ' || cast(p_size as varchar) as description,
           'docs/part_' || cast(p_partkey as varchar) || '.md' as source_file from part
""")
def doc_commands(c):
    raw = extract.extract_documents(c.files("md", "notes"), rules=["command"])
    return raw.entities.select("project", "name", "description", "source_file")


@query("""
    select replace(p_brand, '#', '_') as project, p_type as name, 'Made by ' || p_brand || '.' as description,
           'docs/part_' || cast(p_partkey as varchar) || '.md' as source_file from part
    union all
    select source, 'Notes ' || lang, trim(regexp_extract(
        text, '^(?:[ \\t\\r\\f\\v]*(?:(?:#|```)[^\\n]*)?\\n)*([^\\n]*)', 1), ' ' || chr(9) || chr(13)),
        'notes/' || cast(doc_id as varchar) || '.md' from documents
""")
def heading_modules(c):
    raw = extract.extract_documents(c.files("md", "notes"), rules=["heading"])
    return raw.entities.select("project", "name", "description", "source_file")


@query("""
    select replace(p_brand, '#', '_') as project, p_name as source, replace(p_brand, '#', '_') as target,
           'documents' as type, count(*) as documents from part group by 1, 2, 3, 4
""")
def listed_modules(c):
    raw = extract.extract_documents(c.files("md"), rules=["listed"])
    # The bold bullet with a dash fits two patterns; both give the same edge of the same file.
    edges = raw.relations.select("project", "source", "target", "type", "source_file").distinct()
    return edges.groupBy("project", "source", "target", "type").agg(F.count("*").alias("documents"))


_CODE_ENTITIES = """
    select name, type, description, source_file from (
        select 'order_' || cast(o_orderkey as varchar) as name, 'Module' as type,
               'Order ' || cast(o_orderkey as varchar) || ' module.' as description,
               'orders/order_' || cast(o_orderkey as varchar) || '.py' as source_file from orders
        union all select 'customer_' || cast(c_custkey as varchar), 'Module', c_name,
               'customers/customer_' || cast(c_custkey as varchar) || '.py' from customer
        union all select 'nation_' || cast(n_nationkey as varchar), 'Module', '模块: nations/nation_' || cast(n_nationkey as varchar) || '.py',
               'nations/nation_' || cast(n_nationkey as varchar) || '.py' from nation
        union all select 'region_' || cast(r_regionkey as varchar), 'Module', '模块: regions/region_' || cast(r_regionkey as varchar) || '.py',
               'regions/region_' || cast(r_regionkey as varchar) || '.py' from region
        union all select distinct 'status_' || o_orderstatus, 'Module', '模块: status/status_' || o_orderstatus || '.py',
               'status/status_' || o_orderstatus || '.py' from orders
        union all select 'Order' || cast(o_orderkey as varchar), 'Module', 'Order of customer ' || cast(o_custkey as varchar),
               'orders/order_' || cast(o_orderkey as varchar) || '.py' from orders
        union all select 'order_' || cast(o_orderkey as varchar), 'Feature', 'Read order',
               'orders/order_' || cast(o_orderkey as varchar) || '.py' from orders
        union all select 'total', 'Feature', 'Total price', 'orders/order_' || cast(min(cast(o_orderkey as varchar) || '.py') as varchar) from orders
        union all select 'price', 'Feature', null, 'orders/order_' || cast(min(cast(o_orderkey as varchar) || '.py') as varchar) from orders
        union all select 'customer_' || cast(c_custkey as varchar), 'Feature', c_name,
               'customers/customer_' || cast(c_custkey as varchar) || '.py' from customer
        union all select 'nation_' || cast(n_nationkey as varchar), 'Feature', null,
               'nations/nation_' || cast(n_nationkey as varchar) || '.py' from nation
        union all select 'region_' || cast(r_regionkey as varchar), 'Feature', null,
               'regions/region_' || cast(r_regionkey as varchar) || '.py' from region
        union all select distinct 'status_' || o_orderstatus, 'Feature', null, 'status/status_' || o_orderstatus || '.py' from orders
    ) t
"""


@query(_CODE_ENTITIES)
def code_entities(c):
    raw = extract.extract_code(c.files("code"))
    return dedupe.dedupe_entities(raw.entities).select("name", "type", "description", "source_file")


@query("""
    select source, target, type, count(*) as files from (
        select 'order_' || cast(o_orderkey as varchar) as source, 'Order' || cast(o_orderkey as varchar) as target, 'contains' as type from orders
        union all select 'Order' || cast(o_orderkey as varchar), 'BaseOrder', 'extends' from orders
        union all select 'order_' || cast(o_orderkey as varchar), 'shop', 'depends_on' from orders
        union all select 'order_' || cast(o_orderkey as varchar), 'customer_' || cast(o_custkey as varchar), 'depends_on' from orders
    ) t group by 1, 2, 3
""")
def code_relations(c):
    raw = extract.extract_code(c.files("code"))
    return raw.relations.groupBy("source", "target", "type").agg(F.count("*").alias("files"))


@query("""
    select project, type, count(*) as "count" from (
        select distinct replace(p_brand, '#', '_') as project, p_name as name, 'Document' as type from part
        union select distinct replace(p_brand, '#', '_'), 'dataflow build', 'Command' from part
        union select distinct replace(p_brand, '#', '_'), '/parts/' || cast(p_partkey as varchar), 'API' from part
        union select distinct replace(p_brand, '#', '_'), lower(p_type), 'Module' from part
        union select distinct replace(p_brand, '#', '_'), lower(replace(p_brand, '#', '_')), 'Module' from part
        union select distinct replace(p_brand, '#', '_'), t, k from part,
            (values ('postgresql', 'postgresql', 'Database'), ('postgresql', 'postgres', 'Database'), ('redis', 'redis', 'Database'),
                    ('fastapi', 'fastapi', 'Framework'), ('spring', 'spring', 'Framework')) as x(word, t, k)
        where word = case when p_size % 3 = 0 then 'postgresql' when p_size % 3 = 1 then 'redis' else '' end
           or word = case when p_size % 2 = 0 then 'fastapi' else 'spring' end
    ) t group by 1, 2
""")
def extracted_types(c):
    graph = extract.extract_graph(c.files("md"))
    return graph.entities.groupBy("project", "type").agg(F.count("*").alias("count"))


# All rules over Markdown pages, documents and code; of equal names the first file and rule counts.
_ALL_FACTS = f"""
    f as materialized (select project, path, content from md union all select project, path, content from notes),
    hits as materialized ({_MENTIONS}),
    titled as (select project, path, regexp_extract(content, '^# ([^\\n]*)', 1) as title from f),
    page as (
        select replace(p_brand, '#', '_') as project, 'docs/part_' || cast(p_partkey as varchar) || '.md' as path, p_name, p_type,
               '/parts/' || cast(p_partkey as varchar) as route from part),
    found as (
        select project, path, 0 as kind, 0 as rule, title as name, 'Document' as type from titled
        union all select project, path, 0, 1, term, type from hits
        union all select project, path, 0, 2, route, 'API' from page
        union all select project, path, 0, 3, 'dataflow build', 'Command' from page
        union all select project, path, 0, 4, p_type, 'Module' from page
        union all select source, 'notes/' || cast(doc_id as varchar) || '.md', 0, 4, 'Notes ' || lang, 'Module' from documents
        union all select project, path, 0, 5, project, 'Module' from page
        union all select 'shop', source_file, 1, 0, name, type from ({_CODE_ENTITIES}) code),
    ents as materialized (
        select project, arg_min(name, (kind, path, rule)) as name, type, arg_min(path, (kind, path, rule)) as source_file
        from found group by project, lower(name), type),
    links as (
        select project, path, 0 as rule, title as source, term as target, 'uses' as type from hits join titled using (project, path)
        union all select project, path, 2, p_name, route, 'contains' from page
        union all select project, path, 4, p_name, p_type, 'contains' from page
        union all select source, 'notes/' || cast(doc_id as varchar) || '.md', 4, 'Note ' || cast(doc_id as varchar), 'Notes ' || lang, 'contains' from documents
        union all select project, path, 5, p_name, project, 'documents' from page
        union all select 'shop', 'orders/order_' || cast(o_orderkey as varchar) || '.py', rule, source, target, type from orders, lateral (values
            (1, 'order_' || cast(o_orderkey as varchar), 'Order' || cast(o_orderkey as varchar), 'contains'),
            (2, 'Order' || cast(o_orderkey as varchar), 'BaseOrder', 'extends'),
            (3, 'order_' || cast(o_orderkey as varchar), 'shop', 'depends_on'),
            (4, 'order_' || cast(o_orderkey as varchar), 'customer_' || cast(o_custkey as varchar), 'depends_on')) as x(rule, source, target, type)),
    rels as materialized (
        select project, arg_min(source, (path, rule)) as source, arg_min(target, (path, rule)) as target, type, min(path) as source_file
        from links group by project, lower(source), lower(target), type),
    inferred as (
        select a.project, a.name as source, b.name as target, 'uses' as type, 'inferred' as source_file
        from ents a join ents b on a.project = b.project where a.type = 'Framework' and b.type = 'Database'
        and not exists (select 1 from rels r where r.project = a.project and lower(r.source) = lower(a.name) and lower(r.target) = lower(b.name)))
"""


@query(f", {_ALL_FACTS} select project, name, type, source_file from ents", "md notes")
def extracted_entities(c):
    return extract.extract_graph(c.files("md", "notes", "code")).entities.select("project", "name", "type", "source_file")


@query(f", {_ALL_FACTS} select * from rels union all select * from inferred", "md notes")
def extracted_relations(c):
    return extract.extract_graph(c.files("md", "notes", "code")).relations.select("project", "source", "target", "type", "source_file")


@query(f"""
    select name, type, description, source_file from ({_CODE_ENTITIES}) code
    union all select 'Note ' || doc_id, 'Document', '文档: notes/' || doc_id || '.md', 'notes/' || doc_id || '.md' from documents
""")
def extract_facts(c):
    """Documents and code of several projects in one pass, a few rules of each kind."""
    facts = extract.extract_facts(
        c.files("notes", "code"), documents={"rules": ["document"]}, code={"rules": ["module", "class", "function"]}
    )
    entities = dedupe.dedupe_entities(extract.graph_of_facts(facts).entities)
    return entities.select("name", "type", "description", "source_file")


# --- deduplication and inference --------------------------------------------


@query("select project, name, type, source_file, description from ent", "ent")
def dedupe_entities(c):
    return dedupe.dedupe_entities(c.graph("ent_twice").entities).drop("ord")


@query("select project, source, target, type, description, source_file from rel", "rel")
def dedupe_relations(c):
    return dedupe.dedupe_relations(c.graph("ent", "rel_twice").relations).drop("ord")


@query("""
    select t.project, t.name as source, s.name as target from ent t join ent s on t.project = s.project
    where t.type = 'Tool' and s.type = 'Service' and not exists (
        select 1 from rel where rel.project = t.project and lower(rel.source) = lower(t.name) and lower(rel.target) = lower(s.name))
""", "ent rel")
def infer_relations(c):
    out = dedupe.infer_relations(c.graph(), "Tool", "Service")
    return out.relations.where("source_file = 'inferred'").select("project", "source", "target")


# --- lookups ----------------------------------------------------------------


@query(f"""
    , f as ({FIRST}) select e.project, e.name as asked, f.name, f.type, f.source_file from
    (select distinct project, name from ent_twice) e join f on e.project = f.project and lower(e.name) = f.key
""", "ent_twice ent")
def find_entity(c):
    asked = c.view("ent_twice").select("project", "name")
    return lookup.find_entity(c.graph(), asked).select("project", "asked", "name", "type", "source_file")


@query("select project, name, description, source_file from ent where type = 'Module'", "ent")
def find_entities_by_type(c):
    return lookup.find_entities_by_type(c.graph(), "Module").select("project", "name", "description", "source_file")


_TOUCH = """
    touch as (
        select e.project, e.name as asked, r.source, r.target, r.type, r.description, r.kind, r.pos,
               case when lower(r.source) = lower(e.name) then 'out' else 'in' end as direction,
               case when lower(r.source) = lower(e.name) then r.target else r.source end as other
        from (select distinct project, name from ent) e join rel r on e.project = r.project
         and (lower(r.source) = lower(e.name))
        union all
        select e.project, e.name, r.source, r.target, r.type, r.description, r.kind, r.pos, 'in', r.source
        from (select distinct project, name from ent) e join rel r on e.project = r.project
         and lower(r.target) = lower(e.name) and lower(r.source) <> lower(e.name)
    )
"""


@query(f", {_TOUCH} select project, asked, source, target, type, direction from touch", "ent rel")
def find_relations(c):
    return lookup.find_relations(c.graph(), c.names()).select("project", "asked", "source", "target", "type", "direction")


@query(f"""
    , f as ({FIRST}) select r.project, e.name as asked, f.name as entity, f.type as entity_type
    from (select distinct project, name from ent) e join rel r on e.project = r.project and lower(r.source) = lower(e.name)
    join f on f.project = r.project and f.key = lower(r.target) where r.type = 'depends_on'
""", "ent rel")
def find_dependencies(c):
    return lookup.find_dependencies(c.graph(), c.names()).select("project", "asked", "entity", "entity_type")


@query("""
    select replace(p_brand, '#', '_') as project, replace(p_brand, '#', '_') as asked, p_name as document, count(*) as pages
    from part group by 1, 2, 3
""")
def find_documents(c):
    raw = extract.extract_documents(c.files("md"), rules=["document", "listed"])
    relations = raw.relations.dropDuplicates(["project", "source_file", "source", "target", "type"])
    graph = type(raw)(raw.entities, relations)
    asked = raw.entities.where("type = 'Module'").select("project", "name")
    found = lookup.find_documents(graph, asked)
    return found.groupBy("project", "asked", F.col("entity").alias("document")).agg(F.count("*").alias("pages"))


@query(f"""
    , {_TOUCH}, f as ({FIRST}) select t.project, t.asked, t.direction, t.type as relation, f.name as entity, f.type as entity_type
    from touch t join f on f.project = t.project and f.key = lower(t.other)
""", "ent rel")
def find_related(c):
    return lookup.find_related(c.graph(), c.names()).select(
        "project", "asked", "direction", "relation", "entity", "entity_type"
    )


@query("""
    select project, name, type from ent where contains(lower(name), 'supplier#00000001') or contains(lower(description), 'econ')
""", "ent")
def search_keyword(c):
    by_name = lookup.search_keyword(c.graph(), "Supplier#00000001")
    by_text = lookup.search_keyword(c.graph(), "ECON")
    return by_name.unionByName(by_text).select("project", "name", "type")


@query("""
    , k as (select distinct project, p_type as keyword from part_of
            union select project, replace(s_name, '00000', '') from supplier_of
            union select project, s_name from supplier_of)
    select k.project, k.keyword, e.name, e.type from k join ent e on k.project = e.project
    and (contains(lower(e.name), lower(k.keyword)) or contains(lower(e.description), lower(k.keyword)))
""", "ent part_of supplier_of")
def search_keywords(c):
    keywords = c.view("part_of").select("project", F.col("p_type").alias("keyword")).unionByName(
        c.view("supplier_of").select("project", F.explode(F.array(
            F.replace(F.col("s_name"), F.lit("00000"), F.lit("")), F.col("s_name"))).alias("keyword"))
    )
    return lookup.search_keywords(c.graph(), keywords).select("project", "keyword", "name", "type")


@query(f"""
    , {_TOUCH} select project, asked, case direction when 'out' then 'dependency' else 'dependent' end as role,
    type as relation, other from touch where type in ('depends_on', 'uses')
""", "ent rel")
def dependencies_both(c):
    return lookup.dependencies_both(c.graph(), c.names()).drop("ord")


@query(f"""
    , f as ({FIRST}),
    dep as (select r.project, lower(r.source) as key, f.name as entity, r.kind, r.pos,
                   row_number() over (partition by r.project, lower(r.source) order by r.kind, r.pos) as rn,
                   count(*) over (partition by r.project, lower(r.source)) as n
            from rel r join f on f.project = r.project and f.key = lower(r.target) where r.type = 'depends_on')
    select e.project, e.name as asked, d.entity as dependency, k.entity as child,
           cast(0 as bigint) as more
    from (select distinct project, name from ent) e join dep d on d.project = e.project and d.key = lower(e.name)
    left join dep k on k.project = d.project and k.key = lower(d.entity)
""", "ent rel")
def dependency_tree(c):
    return lookup.dependency_tree(c.graph(), c.names()).select("project", "asked", "dependency", "child", "more")


@query(f"""
    , ask as (select project, name as asked, lower(name) as key from ent where type <> 'Module'
              union select project, replace(s_name, 'upplier', ''), null from supplier_of
              union select project, 'plier#0000' , null from supplier_of),
    found as (select a.project, a.asked, coalesce(a.key, (
        select lower(arg_min(e.name, (e.kind, e.pos))) from ent e where e.project = a.project
        and (contains(lower(e.name), lower(a.asked)) or contains(lower(e.description), lower(a.asked))))) as key from ask a)
    select f.project, f.asked, f.key as entity, 'out' as direction, r.type as relation, r.target as other
    from found f join rel r on r.project = f.project and lower(r.source) = f.key
    union all select f.project, f.asked, f.key, 'in', r.type, r.source
    from found f join rel r on r.project = f.project and lower(r.target) = f.key
""", "ent rel supplier_of")
def relations_of(c):
    asked = c.view("ent").where("type <> 'Module'").select("project", "name").unionByName(
        c.view("supplier_of").select("project", F.explode(F.array(
            F.replace(F.col("s_name"), F.lit("upplier"), F.lit("")), F.lit("plier#0000"))).alias("name"))
    )
    return lookup.relations_of(c.graph(), asked).drop("description", "ord")


@query(f"""
    , {_TOUCH}, f as ({FIRST}) select e.project, e.name as asked, f.name, f.type, f.source_file, t.direction, t.type as relation, t.other
    from (select distinct project, name from ent) e join f on f.project = e.project and f.key = lower(e.name)
    left join touch t on t.project = e.project and t.asked = e.name
""", "ent rel")
def entity_detail(c):
    return lookup.entity_detail(c.graph(), c.names()).drop("description", "ord")


@query("""
    select project, name, total from (
        select project, name, row_number() over (partition by project order by kind, pos) as rn,
               count(*) over (partition by project) as total from ent where type = 'Feature') t
""", "ent")
def category(c):
    return lookup.category(c.graph(), "Feature").select("project", "name", "total")


@query("""
    select project, name, type, total from (
        select project, name, type, row_number() over (partition by project order by kind, pos) as rn,
               count(*) over (partition by project) as total from ent) t
""", "ent")
def list_entities(c):
    return lookup.list_entities(c.graph()).select("project", "name", "type", "total")


@query("""
    select project, source, target, type, total from (
        select project, source, target, type, row_number() over (partition by project order by kind, pos) as rn,
               count(*) over (partition by project) as total from rel) t
""", "rel")
def list_relations(c):
    return lookup.list_relations(c.graph()).select("project", "source", "target", "type", "total")


@query("""
    select project, entities, relations from (select project, count(*) as entities from ent group by 1) e
    join (select project, count(*) as relations from rel group by 1) r using (project)
""", "ent rel")
def list_projects(c):
    return lookup.list_projects(c.graph())


@query(f"""
    , {_TOUCH.replace("touch as (", "touch as materialized (", 1)}
    select project, asked, line from (
        select distinct project, asked, unnest(['graph LR', '    ' || replace(asked, '.', '_') || '["' || asked || '"]:::main',
               '    classDef main fill:#4CAF50,stroke:#388E3C,color:white', '    classDef related fill:#2196F3,stroke:#1565C0,color:white']) as line
        from touch
        union all select project, asked, unnest(['    ' || other || '["' || other || '"]:::related',
               '    ' || asked || ' -->|' || type || '| ' || other]) from touch) t
""", "ent rel")
def ego_mermaid(c):
    return views.ego_lines(c.graph(), c.names()).select("project", "asked", "line")


# --- search -----------------------------------------------------------------


@query("""
    select project, name, type, cast(1.2 as double) as score, 'exact' as match_type, 'name' as match_field
    from ent where lower(name) = 'part#77'
    union all
    select project, name, type, cast(0.8 as double) * cast(1.2 as double), 'contains', 'name' from ent
    where contains(lower(name), 'part#77') and lower(name) <> 'part#77'
""", "ent")
def search_exact(c):
    return search.search(c.graph(), "Part#77").select(
        "project", "name", "type", "score", "match_type", "match_field"
    )


_SCORED = """
    scored as (
        select project, name, type, kind, pos, 0 as f, 'name' as match_field,
               case when lower(name) = q then 1.0::double else 0.8::double end * 1.2::double as score,
               case when lower(name) = q then 'exact' else 'contains' end as match_type, instr(lower(name), q) - 1 as hit
        from ent, q where contains(lower(name), q)
        union all
        select project, name, type, kind, pos, 1, 'description',
               case when lower(description) = q then 1.0::double else 0.8::double end,
               case when lower(description) = q then 'exact' else 'contains' end, instr(lower(description), q) - 1
        from ent, q where contains(lower(description), q)),
    best as (select *, row_number() over (partition by project, name, type order by score desc, kind, pos, f) as rn from scored)
"""


@query(f"""
    , q as (select 'ma' as q), {_SCORED}
    select project, name, type, score, match_type, match_field, hit as start from best where rn = 1
""", "ent")
def search_contains(c):
    return search.search(c.graph(), "MA").select(
        "project", "name", "type", "score", "match_type", "match_field",
        F.col("highlights")[0]["start"].cast("bigint").alias("start"),
    )


@query("""
    , scored as (
        select project, name, type, kind, pos, 0 as f, 'name' as match_field, 0.9::double * 1.2::double as score from ent
        where regexp_matches(lower(name), '^part#[0-9]*7$')
        union all select project, name, type, kind, pos, 1, 'description', 0.9::double from ent
        where regexp_matches(lower(description), '^part#[0-9]*7$'))
    select project, name, type, score, match_field from scored
""", "ent")
def search_regex(c):
    return search.search(c.graph(), "^PART#[0-9]*7$", use_regex=True).select(
        "project", "name", "type", "score", "match_field"
    )


@query("""
    , hit as (select project, name, length(regexp_extract(name, '^(.*?)0(?:[1-9]*)$', 1)) as start from ent where regexp_matches(name, '0[1-9]*$'))
    select project, name, start::bigint as start, length(name)::bigint as "end" from hit
""", "ent")
def search_regex_range(c):
    """Where a pattern bound to the end of a name matches, though its text occurs before as well."""
    hits = search.search(c.graph(), "0[1-9]*$", use_regex=True, search_fields=["name"])
    at = F.col("highlights")[0]
    return hits.select("project", "name", at["start"].cast("bigint").alias("start"), at["end"].cast("bigint").alias("end"))


@query(f"""
    , q as (select 'o' as q), {_SCORED}, ranked as (
        select *, row_number() over (partition by project order by score desc, kind, pos) as place from best where rn = 1)
    select project, name, type, score, match_field from ranked
""", "ent")
def search_multi_project(c):
    return search.search_multi_project(c.graph(), "O").select("project", "name", "type", "score", "match_field")


@query(f"""
    , q as (select 'mer' as q), {_SCORED} select project, name, type, case match_field
    when 'name' then substr(name, 1, hit) || '[' || substr(name, hit + 1, 3) || ']' || substr(name, hit + 4)
    end as shown from best where rn = 1 and match_field = 'name'
""", "ent")
def search_highlight(c):
    hits = search.search_multi_project(c.graph(), "mer", search_fields=["name"])
    return hits.select("project", "name", "type", highlight(F.col("name"), F.col("highlights")).alias("shown"))


@query(f"""
    , {_TOUCH}, f as ({FIRST}),
    near as (select t.project, t.asked, t.direction, t.type as relation, f.name as related, f.type as related_type
             from touch t join f on f.project = t.project and f.key = lower(t.other)),
    n as (select project, asked, count(*) as related_count from near group by 1, 2)
    select e.project, e.name as asked, f.type, coalesce(n.related_count, 0) as related_count, near.direction, near.relation,
           near.related, near.related_type
    from (select distinct project, name from ent) e join f on f.project = e.project and f.key = lower(e.name)
    left join n on n.project = e.project and n.asked = e.name left join near on near.project = e.project and near.asked = e.name
""", "ent rel")
def search_context(c):
    return search.search_with_context(c.graph(), c.names()).select(
        "project", "asked", "type", "related_count", "direction", "relation", "related", "related_type"
    )


# Ratio of the pairs (a, b): the longest common block, the earliest in a, then in b; then left and right of it.
_RATIO = """
    seg as (
        select a, b, 0 as alo, length(a) as ahi, 0 as blo, length(b) as bhi, 0 as k from pair
        union all
        select a, b, n.alo, n.ahi, n.blo, n.bhi, n.k from (
            select a, b, unnest([
                {'alo': alo, 'ahi': alo + i, 'blo': blo, 'bhi': blo + j, 'k': size},
                {'alo': alo + i + size, 'ahi': ahi, 'blo': blo + j + size, 'bhi': bhi, 'k': 0}]) as n
            from (
                select *, -best.n as size, best.i as i, instr(y, x[best.i + 1:best.i - best.n]) - 1 as j from (
                    select *, list_min(flatten([
                        [{'n': -k, 'i': i} for i in range(length(x) - k + 1) if contains(y, x[i + 1:i + k])]
                        for k in range(1, least(length(x), length(y)) + 1)])) as best
                    from (select *, a[alo + 1:ahi] as x, b[blo + 1:bhi] as y from seg where alo < ahi and blo < bhi)
                ) where best is not null
            )
        )
    ),
    ratio as (select a, b, 2.0::double * sum(k) / (length(a) + length(b)) as ratio from seg group by a, b)
"""


def _may_reach(threshold: float) -> str:
    """Whether a and b hold enough characters in common, counted with repeats."""
    held = "length({0}) - length(replace({0}, c, ''))"
    shared = f"list_sum([least({held.format('a')}, {held.format('b')}) for c in list_distinct(string_split(a, ''))])"
    return f"2 * {shared} >= {threshold - 1e-9} * (length(a) + length(b))"


@query(f"""
    , seen as (
        select project, name, type, kind, pos, 0 as f, 'name' as match_field, lower(name) as b, 1.2::double as weight from ent
        union all select project, name, type, kind, pos, 1, 'description', lower(description), 1.0::double from ent where description <> ''),
    pair as (select * from (select distinct 'suplier#000000010' as a, b from seen) where {_may_reach(0.6)}),
    {_RATIO},
    scored as (
        select seen.*, case when b = a then 1.0::double when contains(b, a) then 0.8::double else ratio * 0.7 end as s,
               case when b = a then 'exact' when contains(b, a) then 'contains' else 'fuzzy' end as match_type
        from seen join ratio using (b) where contains(b, a) or ratio >= 0.6),
    best as (
        select *, row_number() over (partition by project, name, type order by s * weight desc, kind, pos, f) as rn from scored)
    select project, name, type, round(s * weight, 9) as score, match_type, match_field from best where rn = 1
""", "ent", recursive=True)
def search_fuzzy(c):
    return search.search(c.graph(), "Suplier#000000010", fuzzy=True).select(
        "project", "name", "type", F.round("score", 9).alias("score"), "match_type", "match_field"
    )


@query(f"""
    , asked as (
        select 'n' as field, replace(s_name, '#0000', ' ') as query from supplier
        union all select 'd', reverse(p_type) || 's' from part union all select 'd', p_type || '-PLATED' from part),
    texts as (
        select project, name, type, 'name' as match_field, lower(name) as b from ent
        union all select project, name, type, 'description', lower(description) from ent where description <> ''),
    pair as (select a, b from (select distinct b from texts) t, (select distinct lower(query) as a from asked) q where {_may_reach(0.75)}),
    {_RATIO}
    select distinct query, project, name, type, match_field, round(ratio, 9) as similarity
    from texts join ratio using (b) join asked on lower(query) = a where ratio >= 0.75
""", "ent", recursive=True)
def search_similar(c):
    suppliers = c.table("supplier").select(F.replace(F.col("s_name"), F.lit("#0000"), F.lit(" ")).alias("query"))
    kinds = c.table("part").select(F.explode(F.array(
        F.concat(F.reverse("p_type"), F.lit("s")), F.concat(F.col("p_type"), F.lit("-PLATED")))).alias("query"))
    found = search.search_similar(c.graph(), suppliers.unionByName(kinds).distinct(), 0.75)
    return found.select("query", "project", "name", "type", "match_field", F.round("similarity", 9).alias("similarity"))


# --- questions --------------------------------------------------------------

_INTENT = "case " + " ".join(
    "when " + " or ".join(f"contains(question, '{w}')" for w in words) + f" then '{intent}'"
    for intent, words in QUESTION_KEYWORDS
) + " else 'general' end"

_LINK = """
    q_low as materialized (select project, question_id, lower(question) as text from questions),
    e_low as materialized (select project, name, type, description, kind, pos, lower(name) as low from ent where length(name) >= 2),
    candidate as materialized (
        select q.project, q.question_id, q.text, e.* exclude (project)
        from q_low q join e_low e on q.project = e.project and contains(q.text, e.low)),
    link as (
        select project, question_id, arg_min(name, (-length(name), kind, pos)) as name,
               arg_min(type, (-length(name), kind, pos)) as type,
               arg_min(coalesce(description, ''), (-length(name), kind, pos)) as description
        from candidate where regexp_matches(text, '(^|[^a-z0-9_])' || low || '($|[^a-z0-9_])')
        group by 1, 2)
"""


@query(f"select question_id, {_INTENT} as intent from questions", "questions")
def qa_route(c):
    return answers.route_questions(c.view("questions")).select("question_id", "intent")


@query(f", {_LINK} select question_id, name, type from link", "questions ent")
def qa_link(c):
    return answers.link_entities(c.view("questions"), c.graph()).select("question_id", "name", "type")


def _answer_lists() -> str:
    """Headings of the list answers, as literal texts."""
    parts = []
    for intent, type_, heads, nothing in (
        ("tech", "Framework", ["项目技术栈:", "", "框架:"], "项目技术栈:"),
        ("databases", "Database", ["项目使用的数据库:"], "项目中没有发现数据库信息。"),
        ("tools", "Tool", ["项目使用的工具:"], "项目中没有发现工具信息。"),
        ("modules", "Module", ["项目包含以下模块:"], "项目中没有发现模块信息。"),
        ("documents", "Document", ["项目包含以下文档:"], "项目中没有发现文档信息。"),
    ):
        has = f"exists (select 1 from ent where ent.project = r.project and ent.type = '{type_}')"
        for texts, condition in ((heads, has), ([nothing], f"not {has}")):
            parts += [f"select r.question_id, '{t}' as line from routed r where intent = '{intent}' and {condition}" for t in texts]
    return " union all ".join(parts)


@query(f"""
    , routed as (select project, question_id, question, {_INTENT} as intent from questions), {_LINK}, {_TOUCH}, f as ({FIRST}),
    few as (select t.project, t.asked, f.name as names from touch t join f on f.project = t.project and f.key = lower(t.other)),
    deps as (select r.project, lower(r.source) as key, f.name from rel r join f on f.project = r.project and f.key = lower(r.target)
             where r.type = 'depends_on'),
    gen as (select r.question_id, e.name, e.type, e.source_file from routed r join ent e on e.project = r.project where r.intent = 'general'
              and (contains(lower(e.name), lower(r.question)) or contains(lower(e.description), lower(r.question))))
    select question_id, line from (
        select r.question_id, l.name || ' 是项目中的 ' || l.type || '。' as line from routed r join link l using (project, question_id) where intent = 'what_is'
        union all select r.question_id, '描述: ' || l.description from routed r join link l using (project, question_id)
            where intent = 'what_is' and l.description <> ''
        union all select r.question_id, '相关实体: ' || few.names from routed r join link l using (project, question_id)
            join few on few.project = l.project and few.asked = l.name where intent = 'what_is'
        union all select r.question_id, '抱歉，我找不到相关的实体信息。' from routed r left join link l using (project, question_id)
            where intent = 'what_is' and l.name is null
        union all select r.question_id, '  - ' || d.name from routed r join link l using (project, question_id)
            join deps d on d.project = l.project and d.key = lower(l.name) where intent = 'dependencies'
        union all select r.question_id, l.name || case when exists (select 1 from deps d where d.project = l.project and d.key = lower(l.name))
            then ' 依赖于:' else ' 没有发现依赖关系。' end from routed r join link l using (project, question_id) where intent = 'dependencies'
        union all select r.question_id, '抱歉，我找不到相关的依赖信息。' from routed r left join link l using (project, question_id)
            where intent = 'dependencies' and l.name is null
        union all select question_id, '  - ' || name || ' (' || type || ')' || ' [来源: ' || source_file || ']' from gen
        union all select r.question_id, case when exists (select 1 from gen g where g.question_id = r.question_id)
            then '找到相关实体:' else '抱歉，我无法回答这个问题。请尝试更具体的问题，例如:' end from routed r where intent = 'general'
        union all select r.question_id, x from routed r, unnest(['  - 有哪些模块?', '  - 技术栈是什么?', '  - 使用了哪些数据库?']) t(x)
            where intent = 'general' and not exists (select 1 from gen g where g.question_id = r.question_id)
        union all {_answer_lists()}
    ) t
""", "questions ent rel")
def qa_answers(c):
    return answers.answer(c.view("questions"), c.graph()).select("question_id", "line")


@query("select * from (" + " union all ".join(
    f"select project, '{intent}' as intent, '  - ' || name as line from ent where type = '{type_}'"
    for intent, type_ in (("tech", "Framework"), ("databases", "Database"), ("tools", "Tool"), ("modules", "Module"), ("documents", "Document"))
) + ") t", "ent")
def qa_lists(c):
    return answers.answer_lists(c.graph()).select("project", "intent", "line")


# --- summaries --------------------------------------------------------------


@query("""
    select project, type, count(*) as "count", round(count(*) / sum(count(*)) over (partition by project) * 100, 1) as percent
    from ent group by 1, 2
""", "ent")
def type_summary(c):
    return summary.entity_type_summary(c.graph())


@query('select project, type, count(*) as "count" from rel group by 1, 2', "rel")
def relation_summary(c):
    return summary.relation_type_summary(c.graph())


@query("""
    select project, kind, type, "count" from (
        select project, 'entity' as kind, type, count(*) as "count" from ent group by 1, 2, 3
        union all select project, 'relation', type, count(*) from rel group by 1, 2, 3
        union all select project, 'entity', 'total', count(*) from ent group by 1, 2, 3
        union all select project, 'relation', 'total', count(*) from rel group by 1, 2, 3) t
""", "ent rel")
def graph_stats(c):
    return summary.stats(c.graph())


@query("select project, type, name from ent where type in ('Framework', 'Database', 'Tool', 'Protocol')", "ent")
def tech_groups(c):
    return summary.tech_groups(c.graph()).drop("ord")


@query("""
    select project, name, description from (
        select *, row_number() over (partition by project order by kind, pos) as rn from ent where type = 'Module') t
""", "ent")
def top_modules(c):
    return summary.top_modules(c.graph()).drop("ord")


@query("""
    select project, sum(entities)::bigint as entities, sum(relations)::bigint as relations from (
        select project, count(*) as entities, 0 as relations from ent group by 1
        union all select project, 0, count(*) from rel group by 1) t group by rollup (project)
""", "ent rel")
def batch_summary(c):
    return summary.batch_summary(c.graph()).select("project", "entities", "relations")


# --- diff -------------------------------------------------------------------


@query("""
    select coalesce(n.project, o.project) as project, coalesce(n.name, o.name) as name, o.type as old_type, n.type as new_type,
           o.description as old_description, n.description as new_description,
           case when o.name is null then 'added' when n.name is null then 'deleted' else 'modified' end as change_type
    from ent_old o full outer join ent_new n on o.project = n.project and o.name = n.name and o.type = n.type
    where o.name is null or n.name is null or o.description is distinct from n.description
       or o.source_file is distinct from n.source_file
""", "ent_old ent_new")
def diff_entities(c):
    return diff.diff_entities(c.graph("ent_old", "rel_old"), c.graph("ent_new", "rel_new")).select(
        "project", "name", "old_type", "new_type", "old_description", "new_description", "change_type"
    )


@query("""
    , o as materialized (select project, source, target, type as relation_type from rel_old),
    n as materialized (select project, source, target, type as relation_type from rel_new)
    select *, 'added' as change_type from (select * from n except select * from o)
    union all select *, 'deleted' from (select * from o except select * from n)
""", "rel_old rel_new")
def diff_relations(c):
    return diff.diff_relations(c.graph("ent_old", "rel_old"), c.graph("ent_new", "rel_new")).drop("description", "ord")


_DIFF_COUNTS = """
    e as (select coalesce(n.project, o.project) as project, o.name is null as a, n.name is null as d,
                 o.name is not null and n.name is not null and o.description is distinct from n.description as m
          from ent_old o full outer join ent_new n on o.project = n.project and o.name = n.name and o.type = n.type),
    r as (select coalesce(n.project, o.project) as project, o.source is null as a, n.source is null as d
          from rel_old o full outer join rel_new n on o.project = n.project and o.source = n.source and o.target = n.target and o.type = n.type),
    es as (select project, count(*) filter (a) as entities_added, count(*) filter (d) as entities_deleted,
                  count(*) filter (m) as entities_modified from e group by 1),
    rs as (select project, count(*) filter (a) as relations_added, count(*) filter (d) as relations_deleted from r group by 1),
    counts as (
        select es.*, rs.relations_added, rs.relations_deleted,
               (select count(*) from ent_old x where x.project = es.project) as old_entity_count,
               (select count(*) from ent_new x where x.project = es.project) as new_entity_count,
               (select count(*) from rel_old x where x.project = es.project) as old_relation_count,
               (select count(*) from rel_new x where x.project = es.project) as new_relation_count
        from es join rs using (project))
"""


@query(f", {_DIFF_COUNTS} select * from counts", "ent_old ent_new rel_old rel_new")
def diff_stats(c):
    return diff.diff_stats(c.graph("ent_old", "rel_old"), c.graph("ent_new", "rel_new"))


_DIFF_ROWS = """
    ec as (
        select coalesce(n.project, o.project) as project, coalesce(n.name, o.name) as name, coalesce(n.type, o.type) as type,
               o.description as od, n.description as nd, o.source_file as os, n.source_file as ns,
               case when o.name is null then 'a' when n.name is null then 'd' else 'm' end as c
        from ent_old o full outer join ent_new n on o.project = n.project and o.name = n.name and o.type = n.type
        where o.name is null or n.name is null or o.description is distinct from n.description or o.source_file is distinct from n.source_file),
    rc as (
        select coalesce(n.project, o.project) as project, coalesce(n.source, o.source) || ' --[' || coalesce(n.type, o.type) || ']--> '
               || coalesce(n.target, o.target) as edge, case when o.source is null then 'a' else 'd' end as c
        from rel_old o full outer join rel_new n on o.project = n.project and o.source = n.source and o.target = n.target and o.type = n.type
        where o.source is null or n.source is null)
"""


@query(f"""
    , {_DIFF_COUNTS}, {_DIFF_ROWS}
    select project, 0 as section, unnest(['📊 图谱对比摘要', repeat('=', 40),
        '实体: ' || old_entity_count || ' → ' || new_entity_count, '关系: ' || old_relation_count || ' → ' || new_relation_count,
        '', '变更统计:', '  实体: +' || entities_added || ' -' || entities_deleted || ' ~' || entities_modified,
        '  关系: +' || relations_added || ' -' || relations_deleted]) as line from counts
    union all select distinct project, 1, unnest(['', '📦 实体变更', repeat('-', 40)]) from ec
    union all select distinct project, 2, unnest(['', '✅ 新增:']) from ec where c = 'a'
    union all select project, 3, '  + ' || name || ' (' || type || ')' from ec where c = 'a'
    union all select project, 3, '    描述: ' || nd from ec where c = 'a' and nd <> ''
    union all select distinct project, 4, unnest(['', '❌ 删除:']) from ec where c = 'd'
    union all select project, 5, '  - ' || name || ' (' || type || ')' from ec where c = 'd'
    union all select distinct project, 6, unnest(['', '🔄 修改:']) from ec where c = 'm'
    union all select project, 7, '  ~ ' || name from ec where c = 'm'
    union all select project, 7, '    描述: ' || coalesce(nullif(od, ''), '(空)') || ' → ' || coalesce(nullif(nd, ''), '(空)')
        from ec where c = 'm' and od is distinct from nd
    union all select project, 7, '    来源: ' || coalesce(nullif(os, ''), '(空)') || ' → ' || coalesce(nullif(ns, ''), '(空)')
        from ec where c = 'm' and os is distinct from ns
    union all select distinct project, 8, unnest(['', '🔗 关系变更', repeat('-', 40)]) from rc
    union all select distinct project, 9, unnest(['', '✅ 新增:']) from rc where c = 'a'
    union all select project, 10, '  + ' || edge from rc where c = 'a'
    union all select distinct project, 11, unnest(['', '❌ 删除:']) from rc where c = 'd'
    union all select project, 12, '  - ' || edge from rc where c = 'd'
""", "ent_old ent_new rel_old rel_new")
def diff_report(c):
    return diff.diff_report(c.graph("ent_old", "rel_old"), c.graph("ent_new", "rel_new")).select(
        "project", "section", "line"
    )


# --- merge ------------------------------------------------------------------

_FOLD = """
    rows_ as (select e.*, o.project_no, row_number() over (partition by name, type order by project_no, kind, pos) as rn,
                     first(description) over w as d1, first(source_file) over w as s1,
                     lag(description) over w as d0, lag(source_file) over w as s0
              from ent_shared e join brand_order o using (project) window w as (partition by name, type order by project_no, kind, pos)),
    marked as (select *, rn > 1 and (description is distinct from d1 or source_file is distinct from s1) as against_first,
                      rn > 1 and (description is distinct from d0 or source_file is distinct from s0) as against_last from rows_)
"""
_SHARED = "ent_shared rel_shared brand_order"


def _shared(c):
    return c.graph("ent_shared", "rel_shared")


@query(f", {_FOLD} select name, type, description, source_file from rows_ where rn = 1", _SHARED)
def merge_skip(c):
    return merge.merge_entities(_shared(c), "skip", c.view("brand_order")).select("name", "type", "description", "source_file")


@query("""
    select type, 2 * count(distinct name) as entities, 2 * count(distinct name) as places from ent group by 1
""", "ent")
def merge_places(c):
    """Two generations of every project merged: each entity has a place of its own."""
    graph = c.graph()
    later = graph.entities.withColumns({"name": F.concat("name", F.lit("+")), "ord": F.col("ord").withField("gen", F.lit(1))})
    merged = merge.merge_graphs(type(graph)(graph.entities.unionByName(later), graph.relations))
    return merged.entities.groupBy("type").agg(F.count("*").alias("entities"), F.countDistinct("ord").alias("places"))


@query(f"""
    , {_FOLD} select name, type, description, source_file from (
        select *, row_number() over (partition by name, type order by project_no desc, kind desc, pos desc) as back from rows_) t where back = 1
""", _SHARED)
def merge_overwrite(c):
    return merge.merge_entities(_shared(c), "overwrite", c.view("brand_order")).select("name", "type", "description", "source_file")


@query(f"""
    , {_FOLD} select name, type, description, source_file from rows_ where rn = 1
    union all select name || ' (' || project || ')', type, description, source_file from (
        select *, row_number() over (partition by name, type, project order by kind desc, pos desc) as back from marked where against_first) t
    where back = 1
""", _SHARED)
def merge_keep_both(c):
    return merge.merge_entities(_shared(c), "keep_both", c.view("brand_order")).select("name", "type", "description", "source_file")


@query(f"""
    , {_FOLD} select name as entity_name, type as new_type, s1 as old_source, source_file as new_source, project from marked where against_first
""", _SHARED)
def merge_conflicts(c):
    return merge.merge_conflicts(_shared(c), "skip", c.view("brand_order")).select(
        "entity_name", "new_type", "old_source", "new_source", "project"
    )


@query(f"""
    , {_FOLD} select name as entity_name, type as new_type, s0 as old_source, source_file as new_source, project from marked where against_last
""", _SHARED)
def merge_conflicts_overwrite(c):
    return merge.merge_conflicts(_shared(c), "overwrite", c.view("brand_order")).select(
        "entity_name", "new_type", "old_source", "new_source", "project"
    )


@query("""
    select source, target, type, min(project_no) as first_project from rel_shared join brand_order using (project) group by 1, 2, 3
""", _SHARED)
def merge_relations(c):
    rows = merge.merge_relations(_shared(c), c.view("brand_order"))
    return rows.select("source", "target", "type", F.col("seq.project_no").alias("first_project"))


@query("""
    , names as (select distinct project, name from ent_shared)
    select r.project || '.' || r.source as source, case when n.name is null then r.target else r.project || '.' || r.target end as target,
           r.type, count(*) as n from rel_shared r left join names n on n.project = r.project and n.name = r.target group by 1, 2, 3
""", _SHARED)
def merge_prefixed(c):
    rows = merge.merge_relations(_shared(c), c.view("brand_order"), prefix=True, dedupe=False)
    return rows.groupBy("source", "target", "type").agg(F.count("*").alias("n"))


@query(f"""
    , {_FOLD} select 'skip' as strategy, count(*) filter (rn = 1) as entities_added,
        count(*) filter (rn > 1) as entities_skipped, count(*) filter (against_first) as conflicts,
        (select count(*) from (select distinct source, target, type from rel_shared) x) as relations_added from marked
    union all select 'overwrite', count(*) filter (rn = 1 or against_last), count(*) filter (rn > 1 and not against_last),
        count(*) filter (against_last), (select count(*) from (select distinct source, target, type from rel_shared) x) from marked
    union all select 'keep_both', count(*) filter (rn = 1 or against_first), count(*) filter (rn > 1 and not against_first),
        count(*) filter (against_first), (select count(*) from (select distinct source, target, type from rel_shared) x) from marked
""", _SHARED)
def merge_stats(c):
    out = None
    for strategy in merge.STRATEGIES:
        row = merge.merge_stats(_shared(c), strategy, c.view("brand_order")).withColumn("strategy", F.lit(strategy))
        out = row if out is None else out.unionByName(row)
    return out.drop("source_projects")


# --- incremental update -----------------------------------------------------

_CHANGES = """
    cur as (select project, path, md5(content) as h from listing),
    changes as (
        select coalesce(c.project, m.project) as project, coalesce(c.path, m.path) as path,
               case when m.path is null then 'added' when c.path is null then 'deleted' else 'modified' end as change_type
        from cur c full outer join manifest m on c.project = m.project and c.path = m.path
        where m.path is null or c.path is null or c.h <> m.content_hash)
"""


def _changes(c):
    current = incremental.current_manifest(c.view("listing"))
    return incremental.detect_changes(current, c.view("manifest"))


@query(f", {_CHANGES} select * from changes", "listing manifest")
def detect_changes(c):
    return _changes(c)


@query(f"""
    , {_CHANGES} select project, path, h as content_hash from cur
""", "listing manifest")
def update_manifest(c):
    current = incremental.current_manifest(c.view("listing"))
    return incremental.update_manifest(c.view("manifest"), current, _changes(c))


@query("""
    select project, 'entity' as side, name as a, type as b from ent where source_file <> 'customer' and source_file <> 'Brand#3'
    union all select project, 'relation', source, target from rel where source_file <> 'customer'
""", "ent rel")
def remove_files(c):
    gone = c.view("ent").select("project", F.col("source_file").alias("path")).where(
        "path in ('customer', 'Brand#3')"
    ).unionByName(c.view("customer_of").select("project", F.lit("customer").alias("path")))
    left = incremental.remove_files(c.graph(), gone)
    return left.entities.select(
        "project", F.lit("entity").alias("side"), F.col("name").alias("a"), F.col("type").alias("b")
    ).unionByName(left.relations.select(
        "project", F.lit("relation").alias("side"), F.col("source").alias("a"), F.col("target").alias("b")
    ))


@query("""
    select o.project, coalesce(n.name, o.name) as name, o.type, case when n.name is null then o.description else n.description end as description,
           o.kind, o.pos, 0 as gen
    from ent_old o left join ent_new n on o.project = n.project and lower(o.name) = lower(n.name) and o.type = n.type
    union all select n.project, n.name, n.type, n.description, n.kind, n.pos, 1 from ent_new n
    where not exists (select 1 from ent_old o where o.project = n.project and lower(o.name) = lower(n.name) and o.type = n.type)
""", "ent_old ent_new")
def upsert(c):
    out = incremental.upsert(c.graph("ent_old", "rel_old"), c.graph("ent_new", "rel_new"))
    return out.entities.select(
        "project", "name", "type", "description", F.col("ord.kind").alias("kind"), F.col("ord.pos").alias("pos"),
        F.col("ord.gen").alias("gen"),
    )


@query(f"""
    , {_CHANGES}, old as (
        select source as project, cast(doc_id as varchar) as path, text as content from documents
        where lang <> 'es'),
    hits as (
        select f.project, f.path, t.term, t.type, g from (
            select project, path, content, 0 as g from old o
            where not exists (select 1 from changes c where c.project = o.project and c.path = o.path and c.change_type = 'deleted')
            union all select l.project, l.path, l.content, 1 from listing l join changes c using (project, path) where c.change_type <> 'deleted'
        ) f, (values {_terms(PROSE_LEXICON)}) as t(term, type) where contains(lower(f.content), t.term))
    select project, term as name, type, max(path) filter (g = (select max(g) from hits h where h.project = hits.project and h.term = hits.term)) as source_file
    from hits where true group by 1, 2, 3
""", "listing manifest")
def apply_incremental(c):
    """A graph of the old listing brought up to date with the new one."""
    old = c.table("documents").where("lang <> 'es'").select(
        F.col("source").alias("project"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")
    )
    options = {"documents": {"rules": ["mention"], "lexicon": PROSE_LEXICON}}

    def files(frame):
        return frame.select(
            "project", "path", F.lit("md").alias("ext"), F.lit("md").alias("kind"), "content",
            F.md5("content").alias("content_hash"),
        )

    base = incremental.apply_incremental(
        files(old), c.view("manifest").limit(0), type(c.graph()).empty(c.spark), generation=1, **options
    )
    update = incremental.apply_incremental(files(c.view("listing")), c.view("manifest"), base.graph, generation=2, **options)
    return update.graph.entities.select("project", "name", "type", "source_file")


def _listings(c) -> tuple[DataFrame, DataFrame]:
    """The documents as notes, as they were and as they are now."""
    def notes(frame):
        text = F.concat(F.lit("# Note "), "path", F.lit("\n"), "content")
        return frame.select(
            "project", "path", F.lit("md").alias("ext"), F.lit("md").alias("kind"), text.alias("content"), F.md5(text).alias("content_hash"))

    old = c.table("documents").where("lang <> 'es'").select(
        F.col("source").alias("project"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return notes(old), notes(c.view("listing"))


_NOTE_RULES = {"documents": {"rules": ["document", "mention"], "lexicon": PROSE_LEXICON}}
_UPDATED = f"""
    {_CHANGES}, old as (
        select source as project, cast(doc_id as varchar) as path, text as content, 0 as g from documents where lang <> 'es'),
    versions as (
        select project, path, content, g from old o
        where not exists (select 1 from changes c where c.project = o.project and c.path = o.path and c.change_type = 'deleted')
        union all select l.project, l.path, l.content, 1 from listing l join changes c using (project, path) where c.change_type <> 'deleted'),
    hits as (
        select project, path, term, type, g from versions, (values {_terms(PROSE_LEXICON)}) as t(term, type)
        where contains(lower('# Note ' || path || chr(10) || content), term)),
    terms as (
        select project, term as name, type, max(path) filter (g = last) as source_file
        from (select *, max(g) over (partition by project, term) as last from hits) group by 1, 2, 3),
    ents as (
        select project, 'Note ' || path as name, 'Document' as type, path as source_file from versions group by all
        union all select * from terms),
    rels as (select distinct project, 'Note ' || path as source, term as target, 'uses' as type, path as source_file from hits)
"""


def _stored_updates(c):
    """A graph store after two listings, a compaction and a third update without changes."""
    old, new = _listings(c)
    store = GraphStore(c.spark, _folder(c))
    first = incremental.update_store(store, old, c.view("manifest").limit(0), **_NOTE_RULES)
    second = incremental.update_store(store, new, first.manifest, **_NOTE_RULES)
    store.compact()
    store.vacuum()
    return incremental.update_store(store, new, second.manifest, **_NOTE_RULES).graph


@query(f", {_UPDATED} select * from ents", "listing manifest")
def stored_updates_entities(c):
    return _stored_updates(c).entities.select("project", "name", "type", "source_file")


@query(f", {_UPDATED} select * from rels", "listing manifest")
def stored_updates_relations(c):
    return _stored_updates(c).relations.select("project", "source", "target", "type", "source_file")


@query(f", {_UPDATED} select * from rels", "listing manifest")
def watched_updates(c):
    """The two listings as they come in a stream; every batch updates the store."""
    store, path, state, manifests = GraphStore(c.spark, _folder(c)), _folder(c), _folder(c), [c.view("manifest").limit(0)]

    def load():
        return _listings(c)[len(manifests) - 1], manifests[-1], store.snapshot()

    def keep(update, batch_id):
        manifests.append(update.manifest)
        store.create(update.graph)

    # One stream that is taken up again for the second listing; a listing is one batch of as many files as it was written in.
    for frame in _listings(c):
        frame.write.mode("append").parquet(path)
        writer = watch_and_update(c.spark.readStream.schema(frame.schema).parquet(path), load, keep, state, **_NOTE_RULES)
        writer.trigger(availableNow=True).start().awaitTermination()
    return store.snapshot().relations.select("project", "source", "target", "type", "source_file")


# --- streaming rules over tables --------------------------------------------


@query("""
    with recursive e as (select event_id, user_id, epoch_us(ts) as t from events),
    kept as (
        select user_id, min(t) as t from e group by 1
        union all
        select k.user_id, (select min(e.t) from e where e.user_id = k.user_id and e.t >= k.t + 3600000000) as t
        from kept k where exists (select 1 from e where e.user_id = k.user_id and e.t >= k.t + 3600000000))
    select user_id, t as us from kept
""", name="debounce")
def debounced(c):
    kept = debounce(c.table("events").select("user_id", "ts"), ["user_id"], 3600.0)
    return kept.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("""
    select project, path from (select project, path from md union all select project, path from code union all select project, path from webapp) f
""", "md code webapp", name="watch_filter")
def watched(c):
    files = c.view("md").select("project", "path")
    for view in ("code", "webapp"):
        files = files.unionByName(c.view(view).select("project", "path"))
    odd = files.select("project", F.explode(F.array(
        F.col("path"), F.concat(F.lit("output/"), "path"), F.concat("path", F.lit(".bak")))).alias("path"))
    return odd.where(watch_filter(F.col("path")))


@query("""
    with recursive e as (select case when user_id % 10 <> 0 then user_id end as user_id, epoch_us(ts) as t from events),
    kept as (
        select user_id, min(t) as t from e group by 1
        union all
        select k.user_id, (select min(e.t) from e where e.user_id is not distinct from k.user_id and e.t >= k.t + 3600000000) as t
        from kept k where exists (select 1 from e where e.user_id is not distinct from k.user_id and e.t >= k.t + 3600000000))
    select user_id, t as us from kept
""")
def debounce_null_keys(c):
    user = F.when(F.col("user_id") % 10 != 0, F.col("user_id"))
    kept = debounce(c.table("events").select(user.alias("user_id"), "ts"), ["user_id"], 3600.0)
    return kept.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("""
    with s as (select cast(user_id as varchar) as path, ts, min(event_type) as now from events group by 1, 2),
    b as (select *, lag(now) over (partition by path order by ts) as before from s)
    select path, case when before is null then 'created' else 'modified' end as change_type, epoch_us(ts) as us
    from b where before is null or before <> now
""")
def watched_changes(c):
    """Snapshots stored as a table, streamed until none is left, changes stored as they come."""
    snapshots, out, state = _folder(c), _folder(c), _folder(c)
    rows = c.table("events").groupBy(F.col("user_id").cast("string").alias("path"), "ts").agg(F.min("event_type").alias("content_hash"))
    rows.select(F.lit("p").alias("project"), "path", "content_hash", "ts").write.parquet(snapshots)
    stream = c.spark.readStream.schema("project string, path string, content_hash string, ts timestamp_ntz").parquet(snapshots)
    writer = watch_changes(stream).writeStream.format("parquet").option("checkpointLocation", state)
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return c.spark.read.parquet(out).select("path", "change_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def _shuffled(c, rows: DataFrame, batches: int = 4) -> DataFrame:
    """Rows with ``ts`` as a stream whose batches are dealt by hash, then two rows of nulls far ahead, which end all blocks."""
    path, files = _folder(c), c.spark.sparkContext.defaultParallelism
    last = rows.agg(F.max("ts").alias("_last"))
    ahead = [
        last.select(*[
            (F.col("_last") + F.expr(f"interval {1000 * (i + 1)} days") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in rows.schema.fields])
        for i in range(2)]
    # All batches in one go; a batch is several files, so that no task writes or reads all of it.
    rows.repartition(batches * files, F.xxhash64(*rows.columns)).write.parquet(path)
    for row in ahead:
        row.coalesce(1).write.mode("append").parquet(path)
    return c.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _drained(c, stream: DataFrame) -> DataFrame:
    out = _folder(c)
    stream.writeStream.format("parquet").option("checkpointLocation", _folder(c)).trigger(availableNow=True).start(out).awaitTermination()
    return c.spark.read.schema(stream.schema).parquet(out)


@query("""
    with recursive e as (select user_id, epoch_us(ts) as t from events),
    kept as (
        select user_id, min(t) as t from e group by 1
        union all
        select k.user_id, (select min(e.t) from e where e.user_id = k.user_id and e.t >= k.t + 3600000000) as t
        from kept k where exists (select 1 from e where e.user_id = k.user_id and e.t >= k.t + 3600000000))
    select user_id, t as us from kept
""")
def debounce_late(c):
    """Events that arrive in no order, as a stream that waits for them."""
    stream = _shuffled(c, c.table("events").select("user_id", "ts"))
    kept = _drained(c, debounce_stream(stream, ["user_id"], 3600.0, delay="500 days")).where("user_id is not null")
    return kept.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("""
    with s as (select cast(user_id as varchar) as path, ts, min(event_type) as now from events group by 1, 2),
    b as (select *, lag(now) over (partition by path order by ts) as before from s)
    select path, case when before is null then 'created' else 'modified' end as change_type, epoch_us(ts) as us
    from b where before is null or before <> now
""")
def watched_changes_late(c):
    """Snapshots that arrive in no order."""
    rows = c.table("events").groupBy(F.col("user_id").cast("string").alias("path"), "ts").agg(F.min("event_type").alias("content_hash"))
    stream = _shuffled(c, rows.select(F.lit("p").alias("project"), "path", "content_hash", "ts"))
    found = _drained(c, watch_changes(stream, delay="500 days", seconds=86400.0)).where("path is not null")
    return found.select("path", "change_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


# --- call flows -------------------------------------------------------------


def _index(files: DataFrame) -> DataFrame:
    """The function index, written once: edges, starts and labels all read it."""
    return cut(callflow.function_index(callflow.extract_functions(files)))


def _endpoints(files: DataFrame) -> DataFrame:
    return cut(callflow.code_endpoints(files))


@query("""
    select name, class_name, description, line_number, calls from (
        select 'total' as name, 'Order' || cast(o_orderkey as varchar) as class_name, 'Total price' as description, 8 as line_number,
               'price' as calls from orders
        union all select 'price', 'Order' || cast(o_orderkey as varchar), null, 12, 'status_' || o_orderstatus from orders
        union all select 'order_' || cast(o_orderkey as varchar), 'Order' || cast(o_orderkey as varchar), 'Read order', 16,
               'customer_' || cast(o_custkey as varchar) || ',get,status_' || o_orderstatus from orders
        union all select 'customer_' || cast(c_custkey as varchar), null, c_name, 1, 'nation_' || cast(c_nationkey as varchar) from customer
        union all select 'nation_' || cast(n_nationkey as varchar), null, null, 1, 'region_' || cast(n_regionkey as varchar) from nation
        union all select 'region_' || cast(r_regionkey as varchar), null, null, 1, 'final' from region
        union all select distinct 'status_' || o_orderstatus, null, null, 1, '' from orders) t
""")
def functions(c):
    return callflow.extract_functions(c.files("code")).select(
        "name", "class_name", "description", "line_number", F.array_join("calls", ",").alias("calls")
    )


@query("""
    select 'GET' as method, '/orders/' || cast(o_orderkey as varchar) as route, 'order_' || cast(o_orderkey as varchar) as handler,
           'orders/order_' || cast(o_orderkey as varchar) || '.py' as file_path from orders
""")
def code_endpoints(c):
    return callflow.code_endpoints(c.files("code")).select("method", "route", "handler", "file_path")


@query("""
    select upper(method) as method, '/' || place || '/' || cast(n_nationkey as varchar) as route, handler || case when handler = 'handler' then '' else '_' || cast(n_nationkey as varchar) end as handler
    from nation, (values ('post', 'app', 'made'), ('put', 'flask', 'kept'), ('delete', 'router', 'gone'), ('get', 'express', 'handler')) as x(method, place, handler)
""")
def code_endpoints_all(c):
    """Decorators of both kinds, routes with methods, and calls of an application object."""
    key = F.col("n_nationkey").cast("string")
    text = F.concat(
        F.lit('@app.post("/app/'), key, F.lit('")\ndef made_'), key, F.lit("(x):\n    return x\n\n@app.route('/flask/"), key,
        F.lit("', methods=['PUT'])\ndef kept_"), key, F.lit("(x):\n    return x\n\n@router.delete(\"/router/"), key,
        F.lit('")\nasync def gone_'), key, F.lit("(x):\n    return x\n\napp.get('/express/"), key, F.lit("', (req, res) => res.send(1));\n"))
    files = as_files(c.table("nation").select(
        F.lit("web").alias("project"), F.concat(F.lit("n_"), key, F.lit(".py")).alias("path"), text.alias("content")))
    return callflow.code_endpoints(files).select("method", "route", "handler")


_LAST_ORDER = "(select max(cast(o_orderkey as varchar) || '.py') from orders)"
_EDGES = f"""
    edges as (
        select 'Order' || cast(o_orderkey as varchar) || '.total' as caller, 'Order' || cast(o_orderkey as varchar) || '.price' as callee from orders
        union all select 'Order' || cast(o_orderkey as varchar) || '.price', 'status_' || o_orderstatus from orders
        union all select 'total', 'Order' || cast(o_orderkey as varchar) || '.price' from orders where cast(o_orderkey as varchar) || '.py' = {_LAST_ORDER}
        union all select 'price', 'status_' || o_orderstatus from orders where cast(o_orderkey as varchar) || '.py' = {_LAST_ORDER}
        union all select p || 'order_' || cast(o_orderkey as varchar), t from (
            select o_orderkey, unnest(['', 'Order' || cast(o_orderkey as varchar) || '.']) as p,
                   'customer_' || cast(o_custkey as varchar) as cu, 'status_' || o_orderstatus as st from orders) o,
            lateral (select cu as t union all select st) x
        union all select 'customer_' || cast(c_custkey as varchar), 'nation_' || cast(c_nationkey as varchar) from customer
        union all select 'nation_' || cast(n_nationkey as varchar), 'region_' || cast(n_regionkey as varchar) from nation)
"""


@query(f"with {_EDGES} select caller, callee from edges")
def call_edges(c):
    index = _index(c.files("code"))
    return callflow.call_edges(index).select("caller", "callee")


@query("""
    select 'Order' || cast(o_orderkey as varchar) || '.total' as key, 'price' as calls from orders
    union all select 'Order' || cast(o_orderkey as varchar) || '.price', 'status_' || o_orderstatus from orders
    union all select 'Order' || cast(o_orderkey as varchar) || '.order_' || cast(o_orderkey as varchar),
        'customer_' || cast(o_custkey as varchar) || ',get,status_' || o_orderstatus from orders
""")
def call_graph(c):
    index = _index(c.files("code"))
    return callflow.call_graph(index).select("key", F.array_join("calls", ",").alias("calls"))


@query("""
    select '/orders/' || cast(o_orderkey as varchar) as route, depth, step from (
        select o.*, c_nationkey, n_regionkey from orders o join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey) o,
    lateral (values (0, 'order_' || cast(o_orderkey as varchar)), (1, 'customer_' || cast(o_custkey as varchar)),
             (1, 'status_' || o_orderstatus), (2, 'nation_' || cast(c_nationkey as varchar)),
             (3, 'region_' || cast(n_regionkey as varchar))) as s(depth, step)
""")
def call_reach_3(c):
    files = c.files("code")
    index = _index(files)
    return callflow.endpoint_flows(_endpoints(files), index, max_depth=3).select("route", "depth", "step")


@query("""
    select '/orders/' || cast(o_orderkey as varchar) as route, 'order_' || cast(o_orderkey as varchar) as handler,
           cast(5 as bigint) as steps_count from orders
""")
def api_summary(c):
    files = c.files("code")
    index = _index(files)
    endpoints = _endpoints(files)
    steps = callflow.endpoint_flows(endpoints, index)
    return callflow.api_summary(endpoints, steps).select("route", "handler", "steps_count")


@query("""
    select 'Order' || cast(o_orderkey as varchar) || '.' || name as entry_point, cast(depth as bigint) as depth
    from orders, lateral (values ('order_' || cast(o_orderkey as varchar), 5), ('total', 3), ('price', 2)) as m(name, depth)
""")
def call_chains(c):
    index = _index(c.files("code"))
    chains, _ = callflow.call_chains(index)
    return chains.select("entry_point", "depth")


@query("""
    select (select count(*) from orders) * 4 + 2 + (select count(*) from customer) + (select count(*) from nation)
           + (select count(*) from region) + (select count(distinct o_orderstatus) from orders) as functions,
           (select count(*) from orders) + (select count(*) from customer) + (select count(*) from nation)
           + (select count(*) from region) + (select count(distinct o_orderstatus) from orders) as files,
           (select count(*) from orders) as endpoints, 3 * (select count(*) from orders) as chains
""")
def flow_stats(c):
    return callflow.flow_stats(callflow.analyze_flows(c.files("code"))).drop("project")


@query("""
    select cast(3 as integer) as number, 'GET' as method, '/orders/' || cast(o_orderkey as varchar) as route,
           'order_' || cast(o_orderkey as varchar) as entry_point, depth, step, d as step_description
    from (select o.*, c_name, c_nationkey, n_regionkey
          from orders o join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
          order by 'orders/order_' || cast(o_orderkey as varchar) || '.py' limit 1 offset 2) o,
    lateral (values (0, 'order_' || cast(o_orderkey as varchar), 'Read order'), (1, 'customer_' || cast(o_custkey as varchar), c_name),
             (1, 'status_' || o_orderstatus, null), (2, 'nation_' || cast(c_nationkey as varchar), null),
             (3, 'region_' || cast(n_regionkey as varchar), null)) as s(depth, step, d)
""")
def flow_item(c):
    flows = callflow.analyze_flows(c.files("code"))
    return callflow.flow_item(flows, 3).select("number", "method", "route", "entry_point", "depth", "step", "step_description")


@query("""
    , flow as (
        select o_orderkey as k, i, step, file, coalesce(d, step) as d, 'API_GET__orders_' || cast(o_orderkey as varchar) as api from (
            select o.*, c_name, c_nationkey, n_regionkey from orders o join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey) o,
        lateral (values
            (0, 'order_' || cast(o_orderkey as varchar), 'orders/order_' || cast(o_orderkey as varchar) || '.py', 'Read order'),
            (1, 'customer_' || cast(o_custkey as varchar), 'customers/customer_' || cast(o_custkey as varchar) || '.py', c_name),
            (2, 'status_' || o_orderstatus, 'status/status_' || o_orderstatus || '.py', null),
            (3, 'nation_' || cast(c_nationkey as varchar), 'nations/nation_' || cast(c_nationkey as varchar) || '.py', null),
            (4, 'region_' || cast(n_regionkey as varchar), 'regions/region_' || cast(n_regionkey as varchar) || '.py', null)) as s(i, step, file, d))
    select '/orders/' || cast(k as varchar) as route, 1 as section, i * 2 as line_no,
           '    ' || api || '_step' || cast(i as varchar) || '["📦 ' || step || '\\n' || d || '\\n📁 ' || file || '"]:::funcNode' as line from flow
    union all select '/orders/' || cast(k as varchar), 1, i * 2 + 1,
           '    ' || api || case when i = 0 then '' else '_step' || cast(i - 1 as varchar) end || ' --> ' || api || '_step' || cast(i as varchar) from flow
    union all select '/orders/' || cast(o_orderkey as varchar), 2, 0, '    API_GET__orders_' || cast(o_orderkey as varchar) || '_end["✅ 返回响应"]:::apiNode' from orders
    union all select '/orders/' || cast(o_orderkey as varchar), 2, 1,
           '    API_GET__orders_' || cast(o_orderkey as varchar) || '_step4 --> API_GET__orders_' || cast(o_orderkey as varchar) || '_end' from orders
""".replace(", flow as", "with flow as"))
def flow_mermaid(c):
    files = c.files("code")
    index = _index(files)
    endpoints = _endpoints(files)
    lines = callflow.flow_lines(endpoints, callflow.endpoint_flows(endpoints, index), index)
    return lines.where("section > 0").select("route", "section", "line_no", "line")


@query("""
    with o as (select 'Order' || o_orderkey as cls, 'order_' || o_orderkey as f, 'customer_' || o_custkey as cu, 'status_' || o_orderstatus as st,
                      'nation_' || c_nationkey as na, 'region_' || n_regionkey as re, c_name, 'orders/order_' || o_orderkey || '.py' as path,
                      'customers/customer_' || o_custkey || '.py' as cp, 'status/status_' || o_orderstatus || '.py' as sp,
                      'nations/nation_' || c_nationkey || '.py' as np, 'regions/region_' || n_regionkey || '.py' as rp
               from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
              ),
    chain as (
        select cls, f as m, 'Read order' as d, path, [{'n': cu, 'd': c_name, 'p': cp}, {'n': st, 'd': st, 'p': sp},
               {'n': na, 'd': na, 'p': np}, {'n': re, 'd': re, 'p': rp}] as steps from o
        union all select cls, 'price', cls || '.price', path, [{'n': st, 'd': st, 'p': sp}] from o
        union all select cls, 'total', 'Total price', path, [{'n': cls || '.price', 'd': cls || '.price', 'p': path}, {'n': st, 'd': st, 'p': sp}] from o),
    c as (select *, '    ' || cls || '_' || m as id, cls || '.' || m as entry_point from chain),
    s as (select *, steps[i] as x, id || '_s' || i as here, id || case when i = 1 then '' else '_s' || (i - 1) end as before
          from (select *, unnest(range(1, len(steps) + 1)) as i from c) t)
    select entry_point, line from (
        select entry_point, id || '["🚀 ' || entry_point || '\\n' || d || '\\n📁 ' || path || '"]:::entryNode' as line from c
        union all select entry_point, here || '["📦 ' || x.n || '\\n' || x.d || '\\n📁 ' || x.p || '"]:::funcNode' from s
        union all select entry_point, before || ' --> ' || trim(here) from s
        union all select entry_point, id || '_end["✅ 结束"]:::entryNode' from c
        union all select entry_point, id || '_s' || len(steps) || ' --> ' || trim(id) || '_end' from c) t
""")
def chain_mermaid(c):
    index = _index(c.files("code"))
    chains, steps = callflow.call_chains(index)
    lines = callflow.chain_lines(chains, steps, index)
    return lines.where("section > 0 or line like '%entryNode' and line like '%🚀%'").select("entry_point", "line")


# --- API data flow ----------------------------------------------------------


@query("""
    select 'GET' as method, '/customers/' || cast(c_custkey as varchar) || '/orders/{id}' as route,
           'read_' || cast(c_custkey as varchar) as handler, 'Read ' || c_name as description, 'Session' as request_body,
           'Session' as dependencies, 'load_' || cast(c_custkey as varchar) as service_calls from customer
""")
def backend_routes(c):
    return apiflow.backend_routes(c.files("webapp")).select(
        "method", "route", "handler", "description", "request_body",
        F.array_join("dependencies", ",").alias("dependencies"), F.array_join("service_calls", ",").alias("service_calls"),
    )


@query("""
    select 'Customer' || cast(c_custkey as varchar) || 'Service' as class_name, '__init__' as name, '' as calls, '' as db_operations from customer
    union all select 'Customer' || cast(c_custkey as varchar) || 'Service', 'load_' || cast(c_custkey as varchar),
        'check,uery,' || case when c_acctbal < 0 then 'll' else 'irst' end,
        'QUERY,' || case when c_acctbal < 0 then 'SELECT_ALL' else 'SELECT_ONE' end from customer
""")
def service_methods(c):
    return apiflow.service_methods(c.files("webapp")).select(
        "class_name", "name", F.array_join("calls", ",").alias("calls"), F.array_join("db_operations", ",").alias("db_operations")
    )


@query("""
    select 'Nation' || cast(n_nationkey as varchar) as name, 'database' as kind, 'id=Integer;name=String' as fields from nation
    union all select 'Nation' || cast(n_nationkey as varchar) || 'In', 'schema', 'name=str' from nation
""")
def data_models(c):
    return apiflow.models(c.files("webapp")).select(
        "name", "kind",
        F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), F.coalesce(f["type"], f["definition"]))), ";").alias("fields"),
    )


@query("""
    select '/customers/' || cast(c_custkey as varchar) || '/orders/{id}' as route, case when f is null then 'Read ' || c_name
           else '前端调用: ' || f end as description
    from customer left join (select o_custkey, max('order_' || cast(o_orderkey as varchar) || '.ts') as f from orders group by 1) o on o_custkey = c_custkey
""")
def match_paths(c):
    files = c.files("webapp")
    return apiflow.match_paths(apiflow.backend_routes(files), apiflow.frontend_calls(files)).select("route", "description")


@query("""
    select '/customers/' || cast(c_custkey as varchar) || '/orders/{id}' as route, 'load_' || cast(c_custkey as varchar) as service_call,
           'Customer' || cast(c_custkey as varchar) || 'Service' as class_name,
           'QUERY,' || case when c_acctbal < 0 then 'SELECT_ALL' else 'SELECT_ONE' end as db_operations from customer
""")
def data_flows(c):
    files = c.files("webapp")
    flows = apiflow.data_flows(apiflow.backend_routes(files), apiflow.service_methods(files))
    return flows.select("route", "service_call", "class_name", F.array_join("db_operations", ",").alias("db_operations"))


@query("""
    , s as (select c_custkey as k, 'Customer' || cast(c_custkey as varchar) || 'Service.' as cls, 'load_' || cast(c_custkey as varchar) as m from customer)
    select 'GET /customers/' || cast(a.k as varchar) || '/orders/{id}' as "from", b.cls || b.m as "to", '调用' as label
    from s a join s b on contains(b.cls || b.m, a.m)
    union all select distinct '🌐 前端', 'GET /customers/' || cast(k as varchar) || '/orders/{id}', '请求' from s
    union all select 'Customer' || cast(c_custkey as varchar) || 'Service.load_' || cast(c_custkey as varchar), '🗄️ 数据库',
        'QUERY, ' || case when c_acctbal < 0 then 'SELECT_ALL' else 'SELECT_ONE' end from customer
""".replace(", s as", "with s as", 1))
def dataflow_graph(c):
    files = c.files("webapp")
    return apiflow.dataflow_graph(apiflow.backend_routes(files), apiflow.service_methods(files)).edges.drop("project")


@query("""
    select 'GET' as method, '/customers/' || o_custkey || '/orders/${id}' as call_path,
           'frontend/src/order_' || o_orderkey || '.ts' as file_path from orders
""")
def frontend_calls(c):
    return apiflow.frontend_calls(c.files("webapp")).select("method", "call_path", "file_path")


@query("""
    with r as (select c_custkey, row_number() over (order by 'backend/app/api/customer_' || c_custkey || '.py') as n from customer),
    s as (select 'Customer' || c_custkey || 'Service' as cls, m, c_custkey, c_acctbal, row_number() over (
              order by 'backend/app/services/customer_' || c_custkey || '.py', m) as n
          from customer, lateral (select unnest(['__init__', 'load_' || c_custkey]) as m) x),
    a as (select c_custkey, cast(n - 1 as varchar) as i from r),
    b as (select cls || '.' || m as method, cast(n - 1 as varchar) as j from s)
    select line from (
        select '    API_' || i || '["GET /customers/' || c_custkey || '/orders/{id}"]:::api' as line from a
        union all select '    Frontend --> API_' || i from a
        union all select '    SVC_' || j || '["' || method || '"]:::service' from b
        union all select '    API_' || i || ' --> SVC_' || j from a join b on contains(method, 'load_' || c_custkey)
        union all select '    SVC_' || j || ' --> DB' from b) t
""")
def dataflow_mermaid(c):
    files = c.files("webapp")
    routes, services = cut(apiflow.backend_routes(files)), cut(apiflow.service_methods(files))
    return apiflow.dataflow_lines(routes, services).where("section in (1, 2, 3, 5)").select("line")


@query("""
    with op as (select c_custkey as k, c_name, 'Customer' || cast(c_custkey as varchar) || 'Service' as cls,
                       case when c_acctbal < 0 then 'll' else 'irst' end as tail,
                       'QUERY, ' || case when c_acctbal < 0 then 'SELECT_ALL' else 'SELECT_ONE' end as ops, f
                from customer left join (select o_custkey, max('order_' || cast(o_orderkey as varchar) || '.ts') as f
                                         from orders group by 1) o on o_custkey = c_custkey)
    select 0 as section, unnest(['# 接口数据流分析报告', '', '## 一、API端点汇总', '', '| 方法 | 路径 | 处理函数 | 描述 |',
                                 '|------|------|----------|------|']) as line
    union all select 1, '| GET | `/customers/' || k || '/orders/{id}` | `read_' || k || '` | '
        || coalesce('前端调用: ' || f, 'Read ' || c_name) || ' |' from op
    union all select 2, unnest(['', '## 二、接口详细数据流', ''])
    union all select 3, '- GET /customers/' || k || '/orders/{id} → read_' || k || '() → load_' || k || '() → ' || ops from op
    union all select 4, unnest(['', '## 三、服务层分析', '', '| 类 | 方法 | 调用的方法 | 数据库操作 |', '|------|------|-----------|-----------|'])
    union all select 5, '| ' || cls || ' | `__init__` | - | - |' from op
    union all select 5, '| ' || cls || ' | `load_' || k || '` | check, uery, ' || tail || ' | ' || ops || ' |' from op
    union all select 6, unnest(['', '## 四、数据模型', ''])
    union all select 7, '- Nation' || n_nationkey || ' (database) `id`: Integer; `name`: String' from nation
    union all select 7, '- Nation' || n_nationkey || 'In (schema) `name`: str' from nation
""")
def dataflow_report(c):
    return apiflow.report_lines(apiflow.dataflow_report(c.files("webapp"))).select("section", "line")


@query("""
    with op as (select c_custkey as k, c_name, 'Customer' || cast(c_custkey as varchar) || 'Service' as cls,
                       case when c_acctbal < 0 then 'll' else 'irst' end as tail,
                       case when c_acctbal < 0 then 'QUERY, SELECT_ALL' else 'QUERY, SELECT_ONE' end as ops, f
                from customer left join (select o_custkey, max('order_' || cast(o_orderkey as varchar) || '.ts') as f
                                         from orders group by 1) o on o_custkey = c_custkey),
    lines as (
        select 0 as section, unnest(['# 接口数据流分析报告', '', '## 一、API端点汇总', '', '| 方法 | 路径 | 处理函数 | 描述 |',
                                     '|------|------|----------|------|']) as line
        union all select 1, '| GET | `/customers/' || k || '/orders/{id}` | `read_' || k || '` | ' || coalesce('前端调用: ' || f, 'Read ' || c_name) || ' |' from op
        union all select 2, unnest(['', '## 二、接口详细数据流', ''])
        union all select 3, unnest(['', '### customer_' || k || ' 模块', '', '', '#### GET /customers/' || k || '/orders/{id}', '',
            '- **处理函数**: `read_' || k || '`', '- **描述**: ' || coalesce('前端调用: ' || f, 'Read ' || c_name), '- **请求体**: `Session`',
            '- **依赖**: Session', '', '**数据流向:**', '```', '前端请求 → GET /customers/' || k || '/orders/{id}', '    ↓', '路由处理器: read_' || k || '()',
            '    ↓', '服务层调用:', '      - load_' || k || '()', '    ↓', '数据库操作: ' || ops, '    ↓', '返回响应', '```']) from op
        union all select 4, unnest(['', '## 三、服务层分析', ''])
        union all select 5, unnest(['', '### ' || cls, '', '- **文件**: `backend/app/services/customer_' || k || '.py`', '- **方法数量**: 2', '',
            '| 方法 | 调用的方法 | 数据库操作 |', '|------|-----------|-----------|', '| `__init__` | - | - |',
            '| `load_' || k || '` | check, uery, ' || tail || ' | ' || ops || ' |']) from op
        union all select 6, unnest(['', '## 四、数据模型', ''])
        union all select 7, unnest(['', '### Nation' || n_nationkey || ' (database)', '', '- **文件**: `backend/app/models/nation_' || n_nationkey || '.py`',
            '- **字段**:', '  - `id`: Integer', '  - `name`: String']) from nation
        union all select 7, unnest(['', '### Nation' || n_nationkey || 'In (schema)', '', '- **文件**: `backend/app/schemas/nation_' || n_nationkey || '.py`',
            '- **字段**:', '  - `name`: str']) from nation)
    select section, line, count(*) as "count" from lines group by 1, 2
""")
def dataflow_document(c):
    lines = apiflow.document_lines(apiflow.dataflow_report(c.files("webapp")))
    return lines.groupBy("section", "line").agg(F.count("*").alias("count"))


# --- history ----------------------------------------------------------------

_COMMITS = """
    num as (select l_orderkey, count(*) filter (l_returnflag <> 'R') as f, sum(case when l_returnflag <> 'R' then cast(l_quantity as bigint) else 0 end) as i,
                   sum(case when l_returnflag <> 'R' then l_linenumber else 0 end) as d from lineitem group by 1),
    com as (select 'repo_' || cast(o_orderkey % 3 as varchar) as repo, o_orderkey as k, 'c' || cast(o_orderkey as varchar) as hash,
                   'order ' || o_orderstatus as message, 'u' || cast(o_custkey % 20 as varchar) as author,
                   'u' || cast(o_custkey % 20 as varchar) || '@x.org' as email, cast(cast(o_orderdate as date) as varchar) as date,
                   coalesce(f, 0)::bigint as files_changed, coalesce(i, 0)::bigint as insertions, coalesce(d, 0)::bigint as deletions
            from orders left join num on l_orderkey = o_orderkey)
"""


@query(f"with {_COMMITS} select repo, hash, message, author, email, date, files_changed, insertions, deletions from com")
def commits(c):
    return history.parse_commits(c.log()).drop("commit")


@query(f"""
    with {_COMMITS} select repo, email, author as name, count(*) as commits, sum(insertions)::bigint as insertions,
    sum(deletions)::bigint as deletions from com group by 1, 2, 3
""")
def contributors(c):
    return history.contributors(history.parse_commits(c.log())).drop("first_seen")


@query(f"""
    with {_COMMITS} select repo, date, sum(insertions)::bigint as insertions, sum(deletions)::bigint as deletions,
    sum(files_changed)::bigint as files from com where files_changed > 0 group by 1, 2
""")
def churn(c):
    return history.code_churn(history.parse_commits(c.log()))


@query(f"""
    with {_COMMITS} select repo, count(*) as total_commits, sum(insertions)::bigint as total_insertions,
    sum(deletions)::bigint as total_deletions, (sum(insertions) - sum(deletions))::bigint as net_change,
    arg_max(date, k) as first_commit, arg_min(date, k) as last_commit from com group by 1
""")
def evolution(c):
    return history.repo_evolution(history.parse_commits(c.log()))


@query(f"with {_COMMITS} select repo, substr(date, 1, 7) as month, count(*) as commits from com group by 1, 2")
def monthly_commits(c):
    return history.monthly_commits(history.parse_commits(c.log()))


@query("""
    select 'repo_' || cast(o_orderkey % 3 as varchar) as repo, 'parts/part_' || cast(l_partkey as varchar) || '.py' as file,
           count(distinct o_orderkey) as total_commits, count(distinct o_custkey % 20) as authors,
           arg_min(cast(cast(o_orderdate as date) as varchar), o_orderkey) as last_modified
    from lineitem join orders on o_orderkey = l_orderkey group by 1, 2
""")
def file_history(c):
    return history.file_history(c.log())


@query("""
    select repo, file, hash from (
        select repo, file, hash, row_number() over (partition by repo, file order by k) as rn from (
            select distinct 'repo_' || cast(o_orderkey % 3 as varchar) as repo, 'parts/part_' || cast(l_partkey as varchar) || '.py' as file,
                   'c' || cast(o_orderkey as varchar) as hash, o_orderkey as k from lineitem join orders on o_orderkey = l_orderkey) x) t
""")
def latest_file_commits(c):
    return history.latest_file_commits(history.file_commits(c.log())).select("repo", "file", "hash")


@query(f"""
    with {_COMMITS}, p as (select repo, author, count(*) as n, min(k) as first_seen from com group by 1, 2),
    t as (select *, row_number() over (partition by repo order by n desc, first_seen) - 1 as i from p)
    select repo, '    C' || cast(i as varchar) || '["' || author || '\\n' || cast(n as varchar) || '次提交"]:::'
           || case when i = 0 then 'topContributor' else 'contributor' end as line from t
    union all select repo, '    C0 -.->|协作| C' || cast(i as varchar) from t where i >= 1
""")
def contributor_mermaid(c):
    lines = history.contributor_lines(history.contributors(history.parse_commits(c.log())))
    return lines.where("section = 1 or section = 3").select("repo", "line")


@query("""
    , f as (select 'web' as repo, regexp_replace(url, '[?#].*$', '') as path from pages),
    e as (select repo, path, case when regexp_matches(path, '[^/.][^/]*\\.[^/.]+$') then regexp_extract(path, '(\\.[^/.]+)$', 1) else '无扩展名' end as ext from f),
    n as (select repo, ext, count(*) as "count", min(path) as first_path from e group by 1, 2)
    select repo, ext, "count", (select count(*) from pages) as total_files from n
""".replace(", f as", "with f as", 1))
def ext_histogram(c):
    files = c.table("pages").select(F.lit("web").alias("repo"), F.regexp_replace("url", "[?#].*$", "").alias("path"))
    return history.file_type_histogram(files)


@query(f"""
    with {_COMMITS} select repo, arg_min(hash, k) as hash, arg_min(message, k) as message, arg_min(author, k) as author,
    arg_min(date, k) as date from com group by 1
""")
def latest_commit(c):
    return history.latest_commit(history.parse_commits(c.log()))


# --- edits ------------------------------------------------------------------


def _entity_requests(c):
    """Per customer: its own entity again, a new one, one of a bad type, the new one again."""
    return c.view("customer_of").select(
        "project",
        F.explode(F.array(
            F.struct((F.col("c_custkey") * 4).alias("request_id"), F.col("c_name").alias("name"), F.lit("Feature").alias("type")),
            F.struct((F.col("c_custkey") * 4 + 1).alias("request_id"), F.col("c_name").alias("name"), F.lit("Service").alias("type")),
            F.struct((F.col("c_custkey") * 4 + 2).alias("request_id"), F.col("c_name").alias("name"), F.lit("Planet").alias("type")),
            F.struct((F.col("c_custkey") * 4 + 3).alias("request_id"), F.col("c_name").alias("name"), F.lit("Service").alias("type")),
        )).alias("r"), F.lit("new").alias("description"), F.lit(None).cast("string").alias("source_file"),
    ).select("project", "r.*", "description", "source_file")


@query("""
    select c_custkey * 4 + i as request_id, status from customer, (values (0, 409), (1, 200), (2, 400), (3, 409)) as s(i, status)
""")
def create_entities(c):
    return mutate.create_entities(c.graph(), _entity_requests(c)).results.drop("project")


@query("""
    select project, name, case when type = 'Tool' and rn = 1 then 'Service' else type end as type,
           case when type = 'Tool' and rn = 1 then 'late' else description end as description, source_file
    from (select *, row_number() over (partition by project, name order by kind, pos) as rn from ent) t
""", "ent")
def update_entities(c):
    rows = c.view("supplier_of")
    none = F.lit(None).cast("string")
    requests = rows.select("project", F.explode(F.array(
        F.struct((F.col("s_suppkey") * 4).alias("request_id"), F.col("s_name").alias("name"), F.lit("Service").alias("type"), F.lit("early").alias("description")),
        F.struct((F.col("s_suppkey") * 4 + 1).alias("request_id"), F.col("s_name").alias("name"), none.alias("type"), F.lit("late").alias("description")),
        F.struct((F.col("s_suppkey") * 4 + 2).alias("request_id"), F.col("s_name").alias("name"), F.lit("Planet").alias("type"), F.lit("never").alias("description")),
        F.struct((F.col("s_suppkey") * 4 + 3).alias("request_id"), F.lower("s_name").alias("name"), none.alias("type"), F.lit("never").alias("description")),
    )).alias("r"), none.alias("source_file")).select("project", "r.*", "source_file")
    return mutate.update_entities(c.graph(), requests).graph.entities.drop("ord")


@query("""
    select s_suppkey as request_id, cast(case when s_acctbal < 0 then 200 else 404 end as integer) as status from supplier
""")
def delete_entities(c):
    requests = c.view("supplier_of").select(
        "project", F.col("s_suppkey").alias("request_id"),
        F.when(F.col("s_acctbal") < 0, F.col("s_name")).otherwise(F.lower("s_name")).alias("name"),
    )
    return mutate.delete_entities(c.graph(), requests).results.drop("project")


@query("""
    select project, source, target, type from rel
    where not exists (select 1 from supplier_of s where s.project = rel.project and (s.s_name = rel.source or s.s_name = rel.target) and s_acctbal < 0)
""", "rel supplier_of")
def delete_cascade(c):
    requests = c.view("supplier_of").where("s_acctbal < 0").select(
        "project", F.col("s_suppkey").alias("request_id"), F.col("s_name").alias("name")
    )
    return mutate.delete_entities(c.graph(), requests).graph.relations.select("project", "source", "target", "type")


@query("""
    select l_orderkey * 8 + l_linenumber as request_id, case
        when ps.project <> pp.project then 404
        when row_number() over (partition by l_suppkey, l_partkey, ps.project = pp.project order by l_orderkey * 8 + l_linenumber) > 1 then 409
        else 200 end as status
    from lineitem join supplier_of ps on ps.s_suppkey = l_suppkey join part_of pp on pp.p_partkey = l_partkey
""", "supplier_of part_of")
def create_relations(c):
    requests = c.table("lineitem").join(c.view("supplier_of"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        "project", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("request_id"), F.col("s_name").alias("source"),
        F.concat(F.lit("part#"), F.col("l_partkey").cast("string")).alias("target"), F.lit("supports").alias("type"),
        F.lit(None).cast("string").alias("description"),
    )
    return mutate.create_relations(c.graph(), requests).results.drop("project")


@query("""
    select project, source, target, type, 0 as gen from rel
    union all select distinct ps.project, s_name, 'part#' || cast(l_partkey as varchar), 'supports', 1
    from lineitem join supplier_of ps on ps.s_suppkey = l_suppkey join part_of pp on pp.p_partkey = l_partkey where ps.project = pp.project
""", "rel supplier_of part_of")
def created_relations(c):
    """The graph with the relations that the requests create."""
    requests = c.table("lineitem").join(c.view("supplier_of"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        "project", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("request_id"), F.col("s_name").alias("source"),
        F.concat(F.lit("part#"), F.col("l_partkey").cast("string")).alias("target"), F.lit("supports").alias("type"),
        F.lit(None).cast("string").alias("description"),
    )
    made = mutate.create_relations(c.graph(), requests).graph.relations
    return made.select("project", "source", "target", "type", F.col("ord.gen").alias("gen"))


@query("select project, source, target, type from rel where type <> 'belongs_to'", "rel")
def delete_relations(c):
    requests = c.view("customer_of").select(
        "project", F.col("c_custkey").alias("request_id"), F.col("c_name").alias("source"), F.col("n_name").alias("target"),
        F.lit("belongs_to").alias("type"),
    )
    return mutate.delete_relations(c.graph(), requests).graph.relations.select("project", "source", "target", "type")


@query("""
    select case r_name when 'ASIA' then 'FAR EAST' else r_name end as project, count(*) as entities
    from ent join region on r_name = project where r_name <> 'EUROPE' group by 1
""", "ent")
def edit_projects(c):
    graph = c.graph()
    projects = c.table("region").select(F.col("r_name").alias("project"))
    moves = c.table("region").select(
        F.col("r_regionkey").alias("request_id"), F.col("r_name").alias("project"),
        F.when(F.col("r_name") == "ASIA", "FAR EAST").otherwise("AFRICA").alias("new_name"),
    )
    moved = mutate.rename_projects(projects, graph, moves)
    gone = c.table("region").where("r_name = 'EUROPE'").select(
        F.col("r_regionkey").alias("request_id"), F.col("r_name").alias("project")
    )
    left = mutate.drop_projects(moved.projects, moved.graph, gone)
    return left.graph.entities.groupBy("project").agg(F.count("*").alias("entities"))


@query(f"""
    select request_id, name, coalesce(type in {_in(ENTITY_TYPES)}, false) as valid from (
        select p_partkey as request_id, p_name as name, p_type as type from part
        union all select 100000000 + pos, name, type from ent where type <> 'Module') t
""", "ent")
def validate_types(c):
    requests = c.table("part").select(
        F.col("p_partkey").alias("request_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type")
    ).unionByName(c.view("ent").where("type <> 'Module'").select((F.col("pos") + 100000000).alias("request_id"), "name", "type"))
    return mutate.validate_types(requests, "entity").select("request_id", "name", "valid")


# --- views and sinks --------------------------------------------------------

_IDS = """
    node as (select *, row_number() over (partition by project order by kind, pos) - 1 as id from ent_twice),
    last as (select project, lower(name) as key, max(id) as id from node group by 1, 2)
"""


@query(f"""
    , {_IDS} select r.project, s.id as "from", t.id as "to", r.type as label from rel r
    join last s on s.project = r.project and s.key = lower(r.source) join last t on t.project = r.project and t.key = lower(r.target)
""", "ent_twice rel")
def graph_view(c):
    return views.graph_view(c.graph("ent_twice")).edges.drop("arrows")


@query(f"""
    , {_IDS} select project, id, name as label, type as "group", type || ': ' || name as title from node
""", "ent_twice")
def graph_view_nodes(c):
    return views.graph_view(c.graph("ent_twice")).nodes


@query(f"""
    , {_IDS}, edge as (select r.project, s.id as a, t.id as b, upper(r.type) as type, r.kind, r.pos from rel r
    join last s on s.project = r.project and s.key = lower(r.source) join last t on t.project = r.project and t.key = lower(r.target))
    select project, row_number() over (partition by project order by kind, pos, a, b) - 1 as id, type, a as "startNode", b as "endNode" from edge
""", "ent_twice rel")
def database_relationships(c):
    return views.database_view(c.graph("ent_twice")).edges.drop("properties")


@query("""
    select project, name, type, coalesce(description, '') as description, coalesce(source_file, '') as source_file from ent
""", "ent")
def csv_entities(c):
    return table_sinks.entity_csv_rows(c.graph())


@query("""
    select project, name as "name:ID", type, coalesce(description, '') as description, coalesce(source_file, '') as source_file,
           'Entity;' || type as ":LABEL" from ent
""", "ent")
def bulk_nodes(c):
    return table_sinks.bulk_node_rows(c.graph())


@query("""
    select project, "source" as ":START_ID", target as ":END_ID", upper(type) as ":TYPE" from rel
""", "rel")
def bulk_relations(c):
    return table_sinks.bulk_relation_rows(c.graph())


@query("select project, source, target, type, coalesce(source_file, '') as source_file from rel", "rel")
def csv_relations(c):
    return table_sinks.relation_csv_rows(c.graph())


@query(f"""
    , {_IDS} select project, id, type, name, coalesce(description, '') as description, coalesce(source_file, '') as source_file from node
""", "ent_twice")
def database_nodes(c):
    nodes = views.database_view(c.graph("ent_twice")).nodes
    return nodes.select(
        "project", "id", F.col("labels")[0].alias("type"), "properties.name", "properties.description", "properties.source_file"
    )


@query("""
    select project, line from (
        select project, 'CREATE (n:' || type || ':Entity {name: ''' || name || ''', type: ''' || type || ''', description: '''
               || coalesce(description, '') || ''', source_file: ''' || source_file || '''});' as line from ent
        union all select project, 'MATCH (a:Entity {name: ''' || source || '''}), (b:Entity {name: ''' || target
               || '''}) CREATE (a)-[r:' || upper(type) || ']->(b);' from rel) t
""", "ent rel")
def cypher_lines(c):
    return line_sinks.cypher_lines(c.graph()).where("section in (1, 3)").select("project", "line")


@query("""
    select project, line from (
        select project, '| ' || name || ' | ' || type || ' | ' || coalesce(description, '-') || ' | ' || source_file || ' |' as line from ent
        union all select project, '| ' || source || ' | ' || type || ' | ' || target || ' |' from rel
        union all select project, '| 实体 | ' || cast(count(*) as varchar) || ' |' from ent group by project
        union all select project, '| 关系 | ' || cast(count(*) as varchar) || ' |' from rel group by project) t
""", "ent rel")
def report_lines(c):
    lines = line_sinks.report_lines(c.graph())
    return lines.where("section in (1, 3) or line rlike '^[|] (实体|关系) [|] [0-9]'").select("project", "line")


@query("""
    select project, section, line from (
        select project, 1 as section, case when row_number() over (partition by project order by kind, pos) = 1 then '' else ',' end
               || '{"name":"' || name || '","type":"' || type || '","description":' || coalesce('"' || description || '"', 'null')
               || ',"source_file":"' || source_file || '"}' as line from ent) t
""", "ent")
def graph_json(c):
    return line_sinks.graph_json_lines(c.graph()).where("section = 1").select("project", "section", "line")


@query("""
    select r_regionkey as request_id, r_name as project,
           case when r_name in ('ASIA', 'EUROPE') then 409 else 200 end as status from region
    union all select 1000 + n_nationkey, n_name, 200 from nation
""")
def create_projects(c):
    """Two regions exist already; the others and the nations are new."""
    known = c.table("region").where("r_name in ('ASIA', 'EUROPE')").select(F.col("r_name").alias("project"))
    requests = c.table("region").select(
        F.col("r_regionkey").cast("bigint").alias("request_id"), F.col("r_name").alias("project")
    ).unionByName(c.table("nation").select(
        (F.col("n_nationkey") + 1000).cast("bigint").alias("request_id"), F.col("n_name").alias("project")))
    made = mutate.create_projects(known, requests)
    return made.results.join(requests, "request_id")


# --- plugins ----------------------------------------------------------------


def _heading_plugin(path: str, content: str):
    """Example extractor: text files with a table are entities; one without a full stop is an error."""
    if "." not in content:
        raise ValueError("no sentence")
    entities = [{"name": path, "type": "Document"}] if "|" in content else []
    return entities, []


@query("""
    select source as project, cast(count(*) as bigint) as total, count(*) filter (contains(text, '.')) as success,
           count(*) filter (not contains(text, '.')) as failed, (count(*) filter (contains(text, '.') and contains(text, '|')))::bigint as entities
    from documents group by 1
""")
def plugin_extraction(c):
    registry = plugins.Registry()
    registry.register_extractor("tables", ["txt"], _heading_plugin)
    files = c.table("documents").select(
        F.col("source").alias("project"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )
    totals = plugins.extraction_totals(plugins.file_outcomes(registry.facts(files)))
    return totals.drop("relations")


@query("""
    select project, count(*) as entities, min(name) as first, '<' || project || '>' as shown from ent where type = 'Tool' group by 1
""", "ent")
def plugin_rendering(c):
    """A registered exporter's files and a registered renderer's rows."""
    registry, path = plugins.Registry(), _folder(c)
    registry.register_exporter("names", lambda graph, to: graph.entities.select("project", "name", "type").write.json(to))
    registry.register_renderer("tags", lambda graph, mark: graph.entities.select("project").distinct().select(
        "project", F.concat(F.lit(mark[0]), "project", F.lit(mark[1])).alias("shown")))
    registry.export("names", c.graph(), path)
    names = c.spark.read.schema("project string, name string, type string").json(path).where("type = 'Tool'")
    counts = names.groupBy("project").agg(F.count("*").alias("entities"), F.min("name").alias("first"))
    return counts.join(registry.render("tags", c.graph(), mark="<>"), "project")
