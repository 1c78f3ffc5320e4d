"""Graphs, files, logs and questions derived from the given tables.

The tables hold no source trees, so the inputs of the operators are written as
portable SQL over whole tables: Spark runs it to build the inputs, and the same
text heads the checking SQL. Every view is row-wise or an equi-join of the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.graph import Graph
from graphloom.schema import order_key
from graphloom.session import prepare
from graphloom.sources.tree import as_files

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Lexicon for the invented prose of the documents (term, type, pos).
PROSE_LEXICON = {"Protocol": ["rest"], "Document": ["license", "mit"]}

VIEWS = {
    # A project per region; parts are dealt out to regions by key.
    "part_of": """
        select r_name as project, p.* from part p join region on r_regionkey = p_partkey % 5
    """,
    "supplier_of": """
        select r_name as project, s.*, n_name from supplier s
        join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    """,
    "customer_of": """
        select r_name as project, c.*, n_name from customer c
        join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    """,
    "ent": """
        select r_name as project, r_name as name, 'Project' as type, cast(null as string) as description,
               'region' as source_file, 1 as kind, cast(r_regionkey as bigint) as pos from region
        union all select r_name, n_name, 'Service', null, 'nation', 2, cast(n_nationkey as bigint)
        from nation join region on n_regionkey = r_regionkey
        union all select project, s_name, 'Tool', null, 'supplier', 3, s_suppkey from supplier_of
        union all select project, 'part#' || cast(p_partkey as string), 'Module', p_type, p_brand, 4, p_partkey from part_of
        union all select project, c_name, 'Feature', c_mktsegment, 'customer', 5, c_custkey from customer_of
    """,
    # Suppliers use parts of every region, so four in five of those edges dangle in their project.
    "rel": """
        select r_name as project, n_name as source, r_name as target, 'depends_on' as type,
               cast(null as string) as description, 'nation' as source_file, 1 as kind, cast(n_nationkey as bigint) as pos
        from nation join region on n_regionkey = r_regionkey
        union all select project, s_name, n_name, 'depends_on', null, 'supplier', 2, s_suppkey from supplier_of
        union all select project, c_name, n_name, 'belongs_to', c_mktsegment, 'customer', 3, c_custkey from customer_of
        union all select project, s_name, 'part#' || cast(l_partkey as string), 'uses', null, 'lineitem', 4,
               s_suppkey * 10000000 + l_partkey
        from (select distinct l_suppkey, l_partkey from lineitem) l join supplier_of on l_suppkey = s_suppkey
    """,
    # The same with upper-cased copies behind it.
    "ent_twice": """
        select * from ent
        union all select project, upper(name), type, 'copy', source_file, kind + 10, pos from ent
    """,
    "rel_twice": """
        select * from rel
        union all select project, upper(source), target, type, 'copy', source_file, kind + 10, pos from rel
    """,
    # Two states of the graph: one without PROMO parts and the BUILDING segment, a later one without SMALL
    # parts and the MACHINERY segment, some entities described anew.
    "ent_old": "select * from ent where type <> 'Module' or description <> 'PROMO'",
    "ent_new": """
        select project, name, type,
               case when source_file = 'Brand#7' then description || '!' when type = 'Tool' then '' else description end
               as description, source_file, kind, pos
        from ent where type <> 'Module' or description <> 'SMALL'
    """,
    "rel_old": "select * from rel where type <> 'belongs_to' or description <> 'BUILDING'",
    "rel_new": "select * from rel where type <> 'belongs_to' or description <> 'MACHINERY'",
    # Each brand's view of the part kinds: names that many projects share and describe differently.
    "ent_shared": """
        select p_brand as project, p_name as name, 'Module' as type, p_type as description,
               p_brand as source_file, 1 as kind, p_partkey as pos from part
        union all select p_brand, p_type, 'Feature', null, 'kinds', 2, p_partkey from part
    """,
    "rel_shared": """
        select p_brand as project, p_name as source, p_type as target, 'implements' as type,
               cast(null as string) as description, p_brand as source_file, 1 as kind, p_partkey as pos from part
        union all select p_brand, p_name, 'outside', 'uses', null, p_brand, 2, p_partkey from part
    """,
    "brand_order": """
        select distinct p_brand as project, cast(replace(p_brand, 'Brand#', '') as bigint) as project_no from part
    """,
    # Markdown: a page per part, and the given documents under a heading.
    "md": """
        select replace(p_brand, '#', '_') as project, 'docs/part_' || cast(p_partkey as string) || '.md' as path,
               '# ' || p_name || chr(10) || chr(10) || '## ' || p_type || chr(10) || chr(10) || 'Made by ' || p_brand
               || '.' || chr(10) || chr(10) || '- **' || replace(p_brand, '#', '_') || '** - brand' || chr(10)
               || '- `GET /parts/' || cast(p_partkey as string) || '` - Read part' || chr(10) || chr(10)
               || '```bash' || chr(10) || 'dataflow build --size ' || cast(p_size as string) || chr(10)
               || 'ls' || chr(10) || '```' || chr(10) || chr(10) || '## License' || chr(10) || chr(10) || 'Stored in '
               || case when p_size % 3 = 0 then 'PostgreSQL' when p_size % 3 = 1 then 'Redis' else 'nothing' end
               || ' by ' || case when p_size % 2 = 0 then 'FastAPI' else 'Spring' end || '.' || chr(10) as content
        from part
    """,
    "notes": """
        select source as project, 'notes/' || cast(doc_id as string) || '.md' as path,
               '# Note ' || cast(doc_id as string) || chr(10) || chr(10) || '## Notes ' || lang || chr(10) || chr(10)
               || text || chr(10) as content
        from documents
    """,
    # Code: a module per order, customer, nation and region; orders call customers call nations.
    "code": """
        select 'shop' as project, 'orders/order_' || cast(o_orderkey as string) || '.py' as path,
               '\"\"\"Order ' || cast(o_orderkey as string) || ' module.\"\"\"' || chr(10) || 'import os' || chr(10)
               || 'from shop.customers import customer_' || cast(o_custkey as string) || chr(10) || chr(10)
               || 'class Order' || cast(o_orderkey as string) || '(BaseOrder):' || chr(10)
               || '    \"\"\"Order of customer ' || cast(o_custkey as string) || '\"\"\"' || chr(10) || chr(10)
               || '    def total(self):' || chr(10) || '        \"\"\"Total price\"\"\"' || chr(10)
               || '        return self.price(len(self.lines))' || chr(10) || chr(10)
               || '    def price(self, n):' || chr(10) || '        return status_' || o_orderstatus || '(n)' || chr(10)
               || chr(10) || '@app.get("/orders/' || cast(o_orderkey as string) || '")' || chr(10)
               || 'async def order_' || cast(o_orderkey as string) || '(req):' || chr(10)
               || '    \"\"\"Read order\"\"\"' || chr(10)
               || '    return customer_' || cast(o_custkey as string) || '(status_' || o_orderstatus || '(req.get(1)))'
               || chr(10) as content
        from orders
        union all select 'shop', 'customers/customer_' || cast(c_custkey as string) || '.py',
               'def customer_' || cast(c_custkey as string) || '(x):' || chr(10) || '    \"\"\"' || c_name || '\"\"\"'
               || chr(10) || '    return nation_' || cast(c_nationkey as string) || '(x)' || chr(10)
        from customer
        union all select 'shop', 'nations/nation_' || cast(n_nationkey as string) || '.py',
               'def nation_' || cast(n_nationkey as string) || '(x):' || chr(10)
               || '    return region_' || cast(n_regionkey as string) || '(x)' || chr(10)
        from nation
        union all select 'shop', 'regions/region_' || cast(r_regionkey as string) || '.py',
               'def region_' || cast(r_regionkey as string) || '(x):' || chr(10) || '    return final(x)' || chr(10)
        from region
        union all select 'shop', 'status/status_' || o_orderstatus || '.py',
               'def status_' || o_orderstatus || '(x):' || chr(10) || '    return x' || chr(10)
        from (select distinct o_orderstatus from orders) s
    """,
    # A web application: routes and services per customer, models per nation, pages per order.
    "webapp": """
        select 'shop' as project, 'backend/app/api/customer_' || cast(c_custkey as string) || '.py' as path,
               '@router.get("/customers/' || cast(c_custkey as string) || '/orders/{id}")' || chr(10)
               || 'async def read_' || cast(c_custkey as string) || '(key: int, db: Session = Depends(get_db)):' || chr(10)
               || '    \"\"\"Read ' || c_name || '\"\"\"' || chr(10)
               || '    return await customer_service.load_' || cast(c_custkey as string) || '(db)' || chr(10) as content
        from customer
        union all select 'shop', 'backend/app/services/customer_' || cast(c_custkey as string) || '.py',
               'class Customer' || cast(c_custkey as string) || 'Service:' || chr(10)
               || '    def __init__(self, db):' || chr(10) || '        self.db = db' || chr(10) || chr(10)
               || '    async def load_' || cast(c_custkey as string) || '(self, db):' || chr(10)
               || '        rows = check(db.query(Customer).' || case when c_acctbal < 0 then 'all' else 'first' end
               || '())' || chr(10) || '        return rows' || chr(10) || chr(10)
               || '    def _hidden(self):' || chr(10) || '        return self.load()' || chr(10)
        from customer
        union all select 'shop', 'backend/app/models/nation_' || cast(n_nationkey as string) || '.py',
               'class Nation' || cast(n_nationkey as string) || '(Base):' || chr(10) || '    id = Column(Integer)' || chr(10)
               || '    name = Column(String)' || chr(10)
        from nation
        union all select 'shop', 'backend/app/schemas/nation_' || cast(n_nationkey as string) || '.py',
               'class Nation' || cast(n_nationkey as string) || 'In(BaseModel):' || chr(10) || '    name: str' || chr(10)
        from nation
        union all select 'shop', 'frontend/src/order_' || cast(o_orderkey as string) || '.ts',
               'const r = axios.get(`/customers/' || cast(o_custkey as string) || '/orders/$' || '{id}`);' || chr(10)
        from orders
    """,
    # Commit logs: a header per order, a line per line item.
    "log": """
        select 'repo_' || cast(o_orderkey % 3 as string) as repo, o_orderkey * 8 as line_no,
               'c' || cast(o_orderkey as string) || '|order ' || o_orderstatus || '|u' || cast(o_custkey % 20 as string)
               || '@x.org|' || cast(cast(o_orderdate as date) as string) as line
        from orders
        union all select 'repo_' || cast(l_orderkey % 3 as string), l_orderkey * 8 + l_linenumber,
               case when l_returnflag = 'R' then '-' || chr(9) || '-'
                    else cast(cast(l_quantity as bigint) as string) || chr(9) || cast(cast(l_linenumber as bigint) as string) end
               || chr(9) || 'parts/part_' || cast(l_partkey as string) || '.py'
        from lineitem
    """,
    # Two listings of the documents: the Spanish ones are new, the German ones gone, the French ones changed.
    "manifest": "select source as project, cast(doc_id as string) as path, md5(text) as content_hash from documents where lang <> 'es'",
    "listing": """
        select source as project, cast(doc_id as string) as path,
               case when lang = 'fr' then text || '!' else text end as content
        from documents where lang <> 'de'
    """,
    # Questions: the conversations, and some that name parts and suppliers.
    "questions": """
        select 'EUROPE' as project, conv_id * 1000 + turn as question_id, text as question from conversations
        union all select project, 100000000 + p_partkey, 'explain part#' || cast(p_partkey as string) || ', please' from part_of
        union all select project, 200000000 + s_suppkey, 'what does ' || s_name || ' require?' from supplier_of
    """,
    "urls": """
        select s_suppkey as id, case s_suppkey % 4
               when 0 then 'git@github.com:org_' || cast(s_nationkey as string) || '/repo_' || cast(s_suppkey as string) || '.git'
               when 1 then 'https://github.com/org_' || cast(s_nationkey as string) || '/repo_' || cast(s_suppkey as string) || '/'
               when 2 then ' org_' || cast(s_nationkey as string) || '/repo_' || cast(s_suppkey as string)
               else 'http://example.org/' || cast(s_suppkey as string) end as url
        from supplier
        union all select 100000000 + page_id, url from pages
    """,
    "responses": """
        select 'models' as project, 'part_' || cast(p_partkey as string) as path,
               case when p_partkey % 10 = 3 then 'no json'
               else '{"entities":[{"name":"' || p_name || '","type":"Module","description":"' || p_type
                    || '"},{"name":"' || p_brand || '","type":"Service"},{"name":"craft","type":"Skill"}],'
                    || '"relations":[{"source":"' || upper(p_name) || '","target":"' || p_brand
                    || '","type":"depends_on"},{"source":"' || p_name || '","target":"craft","type":"uses"},{"source":"'
                    || p_brand || '","target":"' || p_name || '","type":"likes"}]}' end as response
        from part
    """,
}
_DEPENDS = {
    "ent": ["part_of", "supplier_of", "customer_of"], "rel": ["supplier_of", "customer_of"],
    "ent_twice": ["ent"], "rel_twice": ["rel"], "ent_old": ["ent"], "ent_new": ["ent"],
    "rel_old": ["rel"], "rel_new": ["rel"], "questions": ["part_of", "supplier_of"],
}


def with_views(*names: str) -> str:
    """``WITH`` clause of the named views and what they need."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in _DEPENDS.get(name, []):
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed) + "\n"


class Corpus:
    """Derived inputs over one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepare(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = f"{with_views(name)} select * from {name}"
        for table in TABLES:
            if re.search(rf"\b{table}\b", sql):
                self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(sql)

    def graph(self, entities: str = "ent", relations: str = "rel") -> Graph:
        def placed(name):
            return self.view(name).withColumn("ord", order_key(F.col("kind"), pos=F.col("pos")))

        return Graph.of(placed(entities), placed(relations))

    def files(self, *views: str) -> DataFrame:
        frames = [self.view(v).select("project", "path", "content") for v in views]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        # Files in their own order of hashes, so that a table of one split still uses all cores.
        return as_files(out.repartition("project", "path"))

    def names(self) -> DataFrame:
        """Every entity name, asked of its own project."""
        return self.view("ent").select("project", "name")

    def log(self) -> DataFrame:
        return self.view("log").withColumn("block", F.floor(F.col("line_no") / 65536))
