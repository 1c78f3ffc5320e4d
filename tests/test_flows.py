import re

from pyspark.sql import functions as F

from graphloom.operators import apiflow, callflow
from graphloom.schema import order_key
from helpers import bag, files

LEDGER = '''class Ledger(Store):
    async def post(self, entry, *,
                   force=False):
        """Post one entry.
        Twice is once."""
        if self._seen(entry):
            return self.total()
        return write_row(entry)

    def total(self):
        return print(len(amounts(self)))

    def _seen(self, entry):

        def same(row):
            return key_of(row)
        return same(entry)

def audit(book):
    """Audit"""
    return print(len(book))

class Report:
    def lines(self):
        return self.total(self)
'''

SHELVES = '''app = make_app()

@app.get("/shelves")
async def all_shelves():
    """All shelves"""
    return open_room()

@app.route('/returns', methods=["POST"])
def take_back():
    return sort_books()

@router.delete("/shelves/{no}")
def clear():
    return None

def open_room():
    """Unlock"""
    return sort_books(open_room)

def sort_books():
    return by_author()

def by_author():
    return by_title()

def by_title():
    return by_year()

def by_year():
    return 1
'''

EXPRESS = '''let app = require('server')();
app.put('/shelves/:no', async (request, reply) => reply.end());
app.get("/authors", (request, reply) => {});
'''


def test_functions(spark):
    rows = callflow.extract_functions(files(spark, {"s.py": LEDGER}))
    got = {r.full_name: r for r in rows.collect()}
    assert {k: r.line_number for k, r in got.items()} == {
        "Ledger.post": 2, "Ledger.total": 10, "Ledger._seen": 13, "Ledger.same": 15, "Ledger.audit": 19, "Report.lines": 24}
    assert got["Ledger.post"].calls == ["_seen", "total", "write_row"]
    assert got["Ledger.post"].description == "Post one entry."
    assert got["Ledger.total"].calls == ["amounts"]
    assert got["Ledger._seen"].calls == ["key_of", "same"]
    assert got["Ledger.same"].calls == ["key_of"]
    assert got["Ledger.audit"].calls == [] and got["Ledger.audit"].description == "Audit"
    assert got["Report.lines"].calls == ["total"]
    reset = callflow.extract_functions(files(spark, {"s.py": LEDGER}), reset_on_dedent=True)
    assert "audit" in {r.full_name for r in reset.collect()}


def test_long_body(spark):
    text = "def f():\n" + "    g()\n\n" * 50000 + "def h():\n    k()"
    rows = callflow.extract_functions(files(spark, {"s.py": text})).collect()
    assert [(r.name, r.calls, r.line_number) for r in rows] == [("f", ["g"], 1), ("h", ["k"], 100002)]


def test_endpoints(spark):
    rows = callflow.code_endpoints(files(spark, {"app.py": SHELVES, "server.js": EXPRESS}))
    assert bag(rows, "method", "route", "handler") == sorted([
        ("GET", "/shelves", "all_shelves"), ("POST", "/returns", "take_back"), ("DELETE", "/shelves/{no}", "clear"),
        ("PUT", "/shelves/:no", "handler"), ("GET", "/authors", "handler")], key=repr)


ODD = """@App.Get('/a')
def a(): pass
x@ROUTER.post("/b")
async def b_2(y): pass
@app.route('/c', METHODS=['put'])
@myapp.get('/d')
app.get('/e')
@app.get('/f')
App.get('/g')
wrapapp.delete ( '/h' )
"""


def test_endpoints_in_odd_texts(spark):
    rows = callflow.code_endpoints(files(spark, {"odd.py": ODD, "none.py": "def app(): pass\n", "last.py": "@app.get('/z')"}))
    assert bag(rows, "method", "route", "handler") == sorted([
        ("GET", "/a", "a"), ("POST", "/b", "b_2"), ("PUT", "/c", "unknown"), ("GET", "/d", "handler"), ("GET", "/e", "handler"),
        ("GET", "/f", "unknown"), ("DELETE", "/h", "handler"), ("GET", "/z", "unknown")], key=repr)


def test_texts_are_looked_through_only_where_they_may_match(spark):
    plan = callflow.code_endpoints(files(spark, {"a.py": "x"}))._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"(?i)contains\(_lowered#", plan)) == len(callflow.ENDPOINTS)


def test_calls_in_odd_texts(spark):
    text = "a(b.c (d),e\t(1)) fé_1( if (g) x\U0001d4d0y(2) 3h() i j(k)"
    frame = spark.createDataFrame([(text,)], "body string").select(callflow.function_calls(F.col("body")).alias("c"))
    assert frame.first().c == sorted(["a", "c", "e", "fé_1", "x\U0001d4d0y", "3h", "j"])


def test_chains_are_found_once(spark):
    index = callflow.function_index(callflow.extract_functions(files(spark, {"app.py": SHELVES})))
    for frame in callflow.call_chains(index):
        assert "Aggregate" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_steps_are_numbered_before_they_are_described(spark):
    flows = callflow.analyze_flows(files(spark, {"app.py": SHELVES}))
    plan = callflow.flow_lines(flows.endpoints, flows.endpoint_steps, flows.index)._jdf.queryExecution().analyzed().toString()
    # The labels of the index are looked up for the lines, not for the number of steps as well.
    assert plan.count("AS step_file") == 1 and "_part" not in plan


def test_flows(spark):
    whole = callflow.analyze_flows(files(spark, {"app.py": SHELVES}))
    assert whole.endpoint_steps.where("route = '/shelves'").count() == 6
    flows = callflow.analyze_flows(files(spark, {"app.py": SHELVES}), max_depth=3)
    steps = flows.endpoint_steps.where("route = '/shelves'").orderBy("depth", "step").collect()
    assert [(r.depth, r.step) for r in steps] == [
        (0, "all_shelves"), (1, "open_room"), (2, "sort_books"), (3, "by_author")]
    summary = callflow.api_summary(flows.endpoints, flows.endpoint_steps)
    assert bag(summary, "route", "steps_count") == [("/returns", 4), ("/shelves", 4), ("/shelves/{no}", 1)]
    numbers = callflow.flow_stats(flows).first()
    assert (numbers.functions, numbers.files, numbers.endpoints, numbers.chains) == (8, 1, 3, 0)
    item = callflow.flow_item(flows, 1).orderBy("depth").collect()
    assert item[0].route == "/shelves" and [r.step_description for r in item] == ["All shelves", "Unlock", None, None]
    lines = [r.line for r in callflow.flow_lines(flows.endpoints, flows.endpoint_steps, flows.index)
             .where("route = '/shelves'").orderBy("section", "line_no").collect()]
    assert '    API_GET__shelves["🌐 GET /shelves"]:::apiNode' in lines
    assert '    API_GET__shelves_step0["📦 all_shelves\\nAll shelves\\n📁 app.py"]:::funcNode' in lines
    assert lines[-1] == "    API_GET__shelves_step3 --> API_GET__shelves_end"


def index(spark, rows):
    """(key, name, class, calls) rows as a function index."""
    df = spark.createDataFrame(
        [("p", k, n, "a.py", c, calls, None, i) for i, (k, n, c, calls) in enumerate(rows)],
        "project string, key string, name string, file_path string, class_name string, calls array<string>, "
        "description string, line_number int",
    )
    return df.withColumn("ord", order_key(pos=F.col("line_number")))


def test_reach_stops_at_three_calls(spark):
    idx = index(spark, [("a", "a", None, ["b", "b"]), ("b", "b", None, ["c"]), ("c", "c", None, ["d", "a"]), ("d", "d", None, ["e"]), ("e", "e", None, [])])
    starts = spark.createDataFrame([("p", "a", "a"), ("p", "zz", "zz")], "project string, start string, node string")
    got = bag(callflow.reach(starts, callflow.call_edges(idx), 3), "start", "node", "depth")
    assert got == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("zz", "zz", 0)]


def test_reach_of_a_long_chain(spark):
    """Seven calls in a row and a way back: every function is reached, once."""
    idx = index(spark, [(f"C.f{i}", f"f{i}", "C", [f"f{(i + 1) % 8}"]) for i in range(8)])
    starts = spark.createDataFrame([("p", "C.f0", "C.f0"), ("p", "zz", "zz")], "project string, start string, node string")
    got = bag(callflow.reach(starts, callflow.call_edges(idx)), "start", "node", "depth")
    assert got == [*[("C.f0", f"C.f{i}", i) for i in range(8)], ("zz", "zz", 0)]


def test_queries_follow_all_calls(spark):
    """The registered queries but call_reach_3, over an endpoint that reaches five calls deep."""
    from types import SimpleNamespace

    from graphloom.plans import queries

    service = "class Service:\n" + "".join(f"    def step{i}(self):\n        return self.step{i + 1}()\n" for i in range(6))
    corpus = SimpleNamespace(files=lambda kind: files(spark, {"app.py": SHELVES, "service.py": service}))
    assert queries.api_summary(corpus).where("route = '/shelves'").first().steps_count == 6
    assert queries.call_chains(corpus).where("entry_point = 'Service.step0'").first().depth == 6
    assert queries.call_reach_3(corpus).where("route = '/shelves'").agg(F.max("depth")).first()[0] == 3
    lines = queries.flow_mermaid(corpus).where("route = '/shelves' and section = 1")
    assert lines.count() == 12
    assert queries.chain_mermaid(corpus).where("entry_point = 'Service.step0' and line like '%📦%'").count() == 5


def test_chains_and_suffix_start(spark):
    idx = index(spark, [
        ("Service.process", "process", "Service", ["validate", "transform", "get", "_x"]),
        ("Service.validate", "validate", "Service", ["check_format"]), ("Service.transform", "transform", "Service", []),
        ("Service.check_format", "check_format", "Service", []), ("Service._private", "_private", "Service", ["validate"])])
    chains, steps = callflow.call_chains(idx)
    assert bag(chains, "entry_point", "depth") == [("Service.process", 4), ("Service.validate", 2)]
    assert steps.where("entry_point = 'Service.process' and step = 'Service.check_format'").first().depth == 2
    lines = [r.line for r in callflow.chain_lines(chains, steps, idx).where("entry_point = 'Service.validate'").orderBy("section", "line_no").collect()]
    assert lines[-1] == "    Service_validate_s1 --> Service_validate_end" and len(lines) == 9
    endpoints = spark.createDataFrame([("p", "GET", "/x", "process", "a.py")], "project string, method string, route string, handler string, file_path string").withColumn("ord", order_key())
    got = callflow.endpoint_flows(endpoints, idx).orderBy("depth", "step").collect()
    assert [r.step for r in got] == ["process", "Service.transform", "Service.validate", "Service.check_format"]


ROUTES = '''from fastapi import Depends

@router.get("/users/{id}")
async def read_user(user_id: int, db: Session = Depends(get_db)):
    """Read a user"""
    data = await user_service.load(db)
    return service.done(data)

@router.post("/users", status_code=201)
def add_user(body: UserIn):
    return user_service.skipped()
'''
SERVICES = '''class UserService:
    def __init__(self, db):
        self.db = db

    async def load(self, db):
        rows = self.check(db.query(User).filter(1))
        return rows.first()

    def _hidden(self):
        return self.db.commit()

class Empty(Base):
    pass
'''
MODELS = '''class User(Base):
    id = Column(Integer, primary_key=True)
    name = Column(String)

class Helper:
    x = Column(Integer)
'''
SCHEMAS = '''class UserIn(BaseModel):
    name: str
    age: int
'''
FRONT = '''axios.get(`/users/${id}`); fetch("/users"); api.delete('/nothing')'''
APP = {
    "backend/app/api/users.py": ROUTES, "backend/app/services/users.py": SERVICES, "backend/app/models/user.py": MODELS,
    "backend/app/schemas/user.py": SCHEMAS, "frontend/src/a.ts": FRONT, "frontend/src/b.vue": 'fetch("/users")',
    "backend/app/api/deep/x.py": ROUTES,
}


def test_api_data_flow(spark):
    f = files(spark, APP)
    routes = apiflow.backend_routes(f)
    assert bag(routes, "method", "route", "handler", "description", "request_body") == [
        ("GET", "/users/{id}", "read_user", "Read a user", "Session"), ("POST", "/users", "add_user", "", None)]
    assert bag(routes, "route", "service_calls") == [("/users", []), ("/users/{id}", ["load", "done"])]
    assert routes.first().dependencies == ["Session"]
    services = apiflow.service_methods(f)
    got = {r.name: r for r in services.collect()}
    assert set(got) == {"__init__", "load"} and got["load"].db_operations == ["QUERY", "FILTER", "SELECT_ONE"]
    assert got["load"].calls[:2] == ["check", "heck"]
    assert bag(apiflow.models(f), "name", "kind") == [("User", "database"), ("UserIn", "schema")]
    fields = {r.name: [(x.name, x.definition or x.type) for x in r.fields] for r in apiflow.models(f).collect()}
    assert fields == {"User": [("id", "Integer, primary_key=True"), ("name", "String")], "UserIn": [("name", "str"), ("age", "int")]}
    calls = apiflow.frontend_calls(f)
    assert bag(calls, "method", "call_path") == [("DELETE", "/nothing"), ("GET", "/users"), ("GET", "/users"), ("GET", "/users/${id}")]
    matched = apiflow.match_paths(routes, calls)
    assert bag(matched, "route", "description") == [("/users", "前端调用: b.vue"), ("/users/{id}", "前端调用: a.ts")]
    flows = apiflow.data_flows(routes, services)
    assert bag(flows, "route", "service_call", "class_name") == sorted([
        ("/users/{id}", "load", "UserService"), ("/users/{id}", "done", None), ("/users", None, None)], key=repr)
    graph = apiflow.dataflow_graph(routes, services)
    assert bag(graph.edges, "from", "to")[0] == ("GET /users/{id}", "UserService.load")
    assert graph.nodes.count() == 6
    lines = [r.line for r in apiflow.dataflow_lines(routes, services).orderBy("section", "line_no").collect()]
    assert "    API_0 --> SVC_1" in lines and "    Frontend --> API_1" in lines and "    SVC_0 --> DB" in lines
    report = [r.line for r in apiflow.report_lines(apiflow.dataflow_report(f)).orderBy("section", "ord").collect()]
    assert "| GET | `/users/{id}` | `read_user` | 前端调用: a.ts |" in report
    assert "- GET /users/{id} → read_user() → load() → QUERY, FILTER, SELECT_ONE" in report


def test_calls_go_to_the_class_they_name(spark):
    """Two services have a method of one name; only where no receiver tells, a single one is taken."""
    route = """
@router.post("/a")
async def a(db: Session = Depends(get_db)):
    await order_service.create(db)
    await books_service.create(db)
    await service.create(db)
    await service.cancel(db)
"""
    def service(name, method, operation):
        return f"class {name}:\n    async def {method}(self, db):\n        return {operation}\n"

    app = {"backend/app/api/a.py": route, "backend/app/services/o.py": service("OrderService", "create", "db.add(1)"),
           "backend/app/services/books_service.py": service("Shelf", "create", "db.delete(1)"),
           "backend/app/services/c.py": service("Desk", "cancel", "db.commit()")}
    f = files(spark, app)
    flows = apiflow.data_flows(apiflow.backend_routes(f), apiflow.service_methods(f))
    assert bag(flows, "call_no", "service_call", "class_name") == [
        (0, "create", "OrderService"), (1, "create", "Shelf"), (2, "create", None), (3, "cancel", "Desk")]
