"""Data flow from front-end calls over API routes and services to the database.

The layer of a file is its directory: ``<backend>/app/{api,services,models,schemas}``
(direct children) and anything under ``<frontend>``. All rules read one file at a
time; the layers are then joined on equal keys.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.grams import substring_join
from graphloom.functions.ordered import dense_index
from graphloom.functions.text import all_matches, base_name, blank_to_null, file_stem, strip
from graphloom.operators.dedupe import keep_one
from graphloom.schema import DB_MARKERS, FRONTEND_EXTENSIONS, NOT_SERVICE_CALLS, order_key
from graphloom.session import cut

# --- fixed values: what routes, services, models and calls look like --------
ROUTES = [
    r"""(?U)@router\.(get|post|put|delete|patch)\s*\(\s*["']([^"']+)["'][^\n]*?\)\s*\n(?:async\s+)?def\s+(\w+)""",
    r"""(?U)@app\.(get|post|put|delete|patch)\s*\(\s*["']([^"']+)["'][^\n]*?\)\s*\n(?:async\s+)?def\s+(\w+)""",
]
DEPENDS = r"(?U)(\w+)\s*:\s*(\w+)\s*=\s*Depends\("
CLASS_SPLIT = r"(?U)(?=class\s)"
CLASS_HEAD = r"(?U)^class\s+(\w+)[^\n]*?:"
METHOD_SPLIT = r"(?U)(?=\n\s*(?:async\s+)?def\s)"
METHOD_HEAD = r"(?U)^\s*(?:async\s+)?def\s+(\w+)\s*\([^)]*\)"
METHOD_BODY = r"(?sU)^\s*(?:async\s+)?def\s+\w+\s*\([^)]*\)(.*)$"
OWN_CALL = r"(?U)(?:await\s+)?(?:self|cls)\.(\w+)\s*\("
DIRECT_CALL = r"(?U)(?<!\.)(\w+)\s*\("
MODEL_HEAD = r"(?U)^class\s+(\w+)\s*\([^)]*Base[^)]*\)"
MODEL_FIELD = r"(?U)(\w+)\s*=\s*Column\(([^)]+)\)"
SCHEMA_HEAD = r"(?U)^class\s+(\w+)\s*\([^)]*BaseModel[^)]*\)"
SCHEMA_FIELD = r"(?U)(\w+)\s*:\s*(\w+)"
FRONTEND_CALLS = [  # pattern, groups of method and path
    (r"""axios\.(get|post|put|delete)\s*\(\s*[`"']([^`"']+)[`"']""", 1, 2),
    (r"""fetch\s*\(\s*[`"']([^`"']+)[`"']""", None, 1),
    (r"""api\.(get|post|put|delete)\s*\(\s*[`"']([^`"']+)[`"']""", 1, 2),
]
SERVICE_CALL = r"(?U)(?:await\s+)?(?:\w+_service|service)\.(\w+)\s*\("
# --- end of fixed values ----------------------------------------------------


class Report(NamedTuple):
    endpoints: DataFrame
    flows: DataFrame
    services: DataFrame
    models: DataFrame


class FlowGraph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def _layer(files: DataFrame, folder: str, backend: str) -> DataFrame:
    return files.where(F.col("path").rlike(rf"(?:^|/)\Q{backend}\E/app/\Q{folder}\E/[^/]+\.py$"))


def backend_routes(files: DataFrame, backend: str = "backend") -> DataFrame:
    """Routes with handler, docstring, last typed parameter, the file's dependencies, and the
    handler's service calls."""
    content = F.col("content")

    def routes(pat: int, pattern: str) -> Column:
        return F.transform(
            all_matches(content, pattern, {"method": 1, "route": 2, "handler": 3}),
            lambda m, i: F.struct(
                F.upper(m["method"]).alias("method"), m["route"].alias("route"),
                m["handler"].alias("handler"), F.lit(pat).alias("pat"), i.alias("pos"),
            ),
        )

    found = F.concat(*[routes(i, p) for i, p in enumerate(ROUTES)])
    rows = _layer(files, "api", backend).select("project", "path", "content", F.explode(found).alias("r"))
    handler = F.col("r.handler")

    def of_handler(before: str, after: str, group: int) -> Column:
        pattern = F.concat(F.lit(before), handler, F.lit(after))
        return F.call_function("regexp_extract", content, pattern, F.lit(group))

    text = of_handler(r"(?sU)async\s+def\s+", r'.*?"""(.*?)"""', 1)
    body_type = of_handler(r"(?U)async\s+def\s+", r"\s*\([^)]*(\w+):\s*(\w+)", 2)
    body = of_handler(r"(?sU)async\s+def\s+", r"\s*\([^)]*\)(.*?)(?=\n@|\ndef\s|\nclass\s|\z)", 1)
    return rows.select(
        "project", "r.method", "r.route", "r.handler", F.col("path").alias("file_path"),
        strip(text).alias("description"), blank_to_null(body_type).alias("request_body"),
        F.regexp_extract_all(content, F.lit(DEPENDS), F.lit(2)).alias("dependencies"),
        F.regexp_extract_all(body, F.lit(SERVICE_CALL), F.lit(1)).alias("service_calls"),
        F.transform(
            F.regexp_extract_all(body, F.lit(SERVICE_CALL), F.lit(0)), lambda m: F.regexp_extract(m, r"(?U)(\w+)\.\w+\s*\($", 1)
        ).alias("service_receivers"),
        order_key(0, F.col("path"), 0, F.col("r.pat"), F.col("r.pos")).alias("ord"),
    )


def db_operations(body: Column) -> Column:
    """Database operations whose markers occur in a text."""
    marks = [F.when(F.contains(body, F.lit(m)), F.lit(op)) for m, op in DB_MARKERS]
    return F.array_compact(F.array(*marks))


def _classes(files: DataFrame, head: str) -> DataFrame:
    """(project, path, c, class_name, text): class sections whose first line fits."""
    sections = files.select("project", "path", F.posexplode(F.split("content", CLASS_SPLIT)).alias("c", "text"))
    return sections.withColumn("class_name", F.regexp_extract("text", head, 1)).where("class_name <> ''")


def service_methods(files: DataFrame, backend: str = "backend") -> DataFrame:
    """Public methods and constructors of service classes with their calls and database operations."""
    pieces = _classes(_layer(files, "services", backend), CLASS_HEAD).select(
        "project", "path", "c", "class_name", F.posexplode(F.split("text", METHOD_SPLIT)).alias("m", "text")
    )
    name = F.regexp_extract("text", METHOD_HEAD, 1)
    methods = pieces.withColumn("name", name).where("name <> ''").where(
        ~F.startswith("name", F.lit("_")) | (F.col("name") == "__init__")
    )
    body = F.regexp_extract("text", METHOD_BODY, 1)
    direct = F.filter(
        F.regexp_extract_all(body, F.lit(DIRECT_CALL), F.lit(1)), lambda n: ~n.isin(NOT_SERVICE_CALLS)
    )
    rows = methods.select(
        "project", "class_name", "name", F.col("path").alias("file_path"),
        F.concat(F.regexp_extract_all(body, F.lit(OWN_CALL), F.lit(1)), direct).alias("calls"),
        db_operations(body).alias("db_operations"),
        order_key(0, F.col("path"), 0, F.col("c"), F.col("m")).alias("ord"),
    )
    return keep_one(rows, [F.col(c) for c in ("project", "class_name", "name")], last=True)


FIELD = "array<struct<name:string,definition:string,type:string>>"


def orm_models(files: DataFrame, backend: str = "backend") -> DataFrame:
    """Classes on a ``Base`` with their columns."""
    fields = F.transform(
        all_matches(F.col("text"), MODEL_FIELD, {"name": 1, "definition": 2}),
        lambda f: F.struct(f["name"].alias("name"), f["definition"].alias("definition"), F.lit(None).cast("string").alias("type")),
    )
    return _models(_classes(_layer(files, "models", backend), MODEL_HEAD), fields, "database", 0)


def schema_models(files: DataFrame, backend: str = "backend") -> DataFrame:
    """Classes on ``BaseModel`` with their typed fields."""
    body = F.regexp_replace("text", SCHEMA_HEAD, "")
    fields = F.transform(
        all_matches(body, SCHEMA_FIELD, {"name": 1, "type": 2}),
        lambda f: F.struct(f["name"].alias("name"), F.lit(None).cast("string").alias("definition"), f["type"].alias("type")),
    )
    return _models(_classes(_layer(files, "schemas", backend), SCHEMA_HEAD), fields, "schema", 1)


def _models(classes: DataFrame, fields: Column, kind: str, layer: int) -> DataFrame:
    return classes.select(
        "project", F.col("class_name").alias("name"), F.lit(kind).alias("kind"), F.col("path").alias("file_path"),
        fields.cast(FIELD).alias("fields"), order_key(layer, F.col("path"), 0, 0, F.col("c")).alias("ord"),
    )


def models(files: DataFrame, backend: str = "backend") -> DataFrame:
    """Models and schemas; the last of a name counts."""
    rows = orm_models(files, backend).unionByName(schema_models(files, backend))
    return keep_one(rows, [F.col("project"), F.col("name")], last=True)


def frontend_calls(files: DataFrame, frontend: str = "frontend") -> DataFrame:
    """API calls with a literal path in front-end files."""
    content = F.col("content")

    def calls(pat: int, pattern: str, method, path) -> Column:
        groups = {"path": path, **({"method": method} if method else {})}
        return F.transform(
            all_matches(content, pattern, groups),
            lambda m, i: F.struct(
                (F.upper(m["method"]) if method else F.lit("GET")).alias("method"), m["path"].alias("call_path"),
                F.lit(pat).alias("pat"), i.alias("pos"),
            ),
        )

    found = F.concat(*[calls(i, *spec) for i, spec in enumerate(FRONTEND_CALLS)])
    rank = F.array_position(F.array(*[F.lit(e) for e in FRONTEND_EXTENSIONS]), F.col("ext"))
    return (
        files.where(F.col("path").rlike(rf"(?:^|/)\Q{frontend}\E/") & F.col("ext").isin(FRONTEND_EXTENSIONS))
        .select("project", "path", rank.alias("rank"), F.explode(found).alias("f"))
        .select(
            "project", "f.method", "f.call_path", F.col("path").alias("file_path"),
            order_key(F.col("rank"), F.col("path"), 0, F.col("f.pat"), F.col("f.pos")).alias("ord"),
        )
    )


def match_paths(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """Routes whose path a front-end call uses are described by the last calling file.

    ``{x}`` of a route and ``${x}`` of a call stand for the same; methods are not compared.
    """
    callers = calls.groupBy("project", F.regexp_replace("call_path", r"\$\{[^}]+\}", ":id").alias("_path")).agg(
        F.max_by(base_name(F.col("file_path")), "ord").alias("_caller")
    )
    return (
        routes.withColumn("_path", F.regexp_replace("route", r"\{[^}]+\}", ":id"))
        .join(callers, ["project", "_path"], "left")
        .withColumn(
            "description",
            F.when(F.col("_caller").isNotNull(), F.concat(F.lit("前端调用: "), "_caller")).otherwise(F.col("description")),
        )
        .drop("_path", "_caller")
    )


def data_flows(routes: DataFrame, services: DataFrame) -> DataFrame:
    """One row per route and service call, with the database operations of the method called; a
    route without service calls has one row of nulls.

    The receiver names the class (``user_service`` is ``UserService``) or its file. Where it names neither,
    the call goes to the method of that name if the project has only one.
    """
    def plain(name) -> Column:
        return F.lower(F.replace(name, F.lit("_"), F.lit("")))

    calls = routes.select(
        "project", "method", "route", "handler", "file_path", "ord",
        F.posexplode_outer(F.arrays_zip("service_calls", "service_receivers")).alias("call_no", "call"),
    ).select(
        "project", "method", "route", "handler", "file_path", "ord", "call_no",
        F.col("call.service_calls").alias("service_call"), plain(F.col("call.service_receivers")).alias("owner"),
    )
    methods = services.select("project", F.col("name").alias("service_call"), "class_name", "db_operations", "file_path")
    # Looked up twice, so the service files are read once; a few columns of what they hold.
    methods = methods if hasattr(services, "stored_at") else cut(methods)
    owners = F.array_distinct(F.array(plain(F.col("class_name")), plain(file_stem(F.col("file_path")))))
    owned = methods.select("project", "service_call", "class_name", "db_operations", F.explode(owners).alias("owner"))
    sole = methods.groupBy("project", "service_call").agg(
        F.count("*").alias("_n"), F.min_by(F.struct("class_name", "db_operations"), "class_name").alias("_only")
    ).where("_n = 1").drop("_n")
    found = calls.join(owned, ["project", "service_call", "owner"], "left").join(sole, ["project", "service_call"], "left")
    return found.select(
        "project", "service_call", "method", "route", "handler", "file_path", "ord", "call_no",
        F.coalesce("class_name", "_only.class_name").alias("class_name"),
        F.coalesce("db_operations", "_only.db_operations").alias("db_operations"),
    )


def dataflow_report(files: DataFrame, backend: str = "backend", frontend: str = "frontend") -> Report:
    """The four tables of the report: endpoints, flows by module, services by class, models."""
    # Each is read by several tables and for the project heads, and is far smaller than the code.
    routes = cut(match_paths(backend_routes(files, backend), frontend_calls(files, frontend)))
    services = cut(service_methods(files, backend))
    defined = cut(models(files, backend))
    flows = data_flows(routes, services).withColumn("module", file_stem(F.col("file_path")))
    return Report(
        routes.select("project", "method", "route", "handler", "description", "request_body", "dependencies", "ord"),
        flows,
        services.select(
            "project", "class_name", "file_path", "name", "calls", "db_operations", "ord",
        ),
        defined.select("project", "name", "kind", "file_path", "fields", "ord"),
    )


def report_lines(report: Report) -> DataFrame:
    """The report as Markdown line rows (project, section, ord, line)."""
    def rows(frame, section, texts):
        items = F.posexplode(F.array_compact(F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])))
        place = F.col("ord").withField("pos", F.col("ord.pos") * 16 + F.col("_i"))
        return frame.select("project", "ord", items.alias("_i", "line")).select(
            "project", F.lit(section).alias("section"), place.alias("ord"), "line"
        )

    def heads(section, *texts):
        return rows(projects, section, texts)

    def listed(col):
        joined = F.array_join(F.col(col), ", ")
        return F.when(F.size(col) > 0, joined).otherwise("-")

    names = [f.select("project") for f in report]
    projects = names[0].union(names[1]).union(names[2]).union(names[3]).distinct().withColumn("ord", order_key())
    endpoint = F.format_string("| %s | `%s` | `%s` | %s |", "method", "route", "handler", "description")
    flow = report.flows
    step = F.when(
        F.col("service_call").isNotNull(),
        F.concat(
            F.format_string("- %s %s → %s() → %s()", "method", "route", "handler", "service_call"),
            F.when(F.size("db_operations") > 0, F.concat(F.lit(" → "), F.array_join("db_operations", ", "))).otherwise(""),
        ),
    ).otherwise(F.format_string("- %s %s → %s()", "method", "route", "handler"))
    service = F.format_string("| %s | `%s` | %s | %s |", "class_name", "name", listed("calls"), listed("db_operations"))
    field = F.array_join(
        F.transform(
            "fields", lambda f: F.format_string("`%s`: %s", f["name"], F.coalesce(f["type"], f["definition"]))
        ), "; ",
    )
    model = F.concat(F.format_string("- %s (%s) ", "name", "kind"), field)
    parts = [
        heads(0, "# 接口数据流分析报告", "", "## 一、API端点汇总", "", "| 方法 | 路径 | 处理函数 | 描述 |", "|------|------|----------|------|"),
        rows(report.endpoints, 1, [endpoint]),
        heads(2, "", "## 二、接口详细数据流", ""),
        rows(flow, 3, [step]),
        heads(4, "", "## 三、服务层分析", "", "| 类 | 方法 | 调用的方法 | 数据库操作 |", "|------|------|-----------|-----------|"),
        rows(report.services, 5, [service]),
        heads(6, "", "## 四、数据模型", ""),
        rows(report.models, 7, [model]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- fixed values: texts of the report --------------------------------------
REPORT_HEAD = ["# 接口数据流分析报告", "", "## 一、API端点汇总", "", "| 方法 | 路径 | 处理函数 | 描述 |", "|------|------|----------|------|"]
REPORT_FLOWS = ["", "## 二、接口详细数据流", ""]
REPORT_SERVICES = ["", "## 三、服务层分析", ""]
REPORT_MODELS = ["", "## 四、数据模型", ""]
REPORT_METHODS = ["", "| 方法 | 调用的方法 | 数据库操作 |", "|------|-----------|-----------|"]
REPORT_ARROW = "    ↓"
# --- end of fixed values ----------------------------------------------------


def document_lines(report: Report, calls: int | None = None, fields: int | None = None) -> DataFrame:
    """The report in full as Markdown line rows (project, section, place, line), in order of section and place.

    Endpoints stand under the module of their file, methods under their class, fields under their model, all or the first
    ``calls`` and ``fields`` of each. An endpoint's flow names every service call and every database operation.
    """
    def key(group, item, slot, n) -> Column:
        """Place within a section: group, item in it, part of the item, number in the part."""
        return F.struct(group.alias("group"), item.alias("item"), F.lit(slot).alias("slot"), n.cast("long").alias("n"))

    def rows(frame, section, group, item, slot, texts) -> DataFrame:
        items = F.array_compact(F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts]))
        exploded = frame.withColumns({"_g": group, "_i": item}).select("project", "_g", "_i", F.posexplode(items).alias("_n", "line"))
        return exploded.select("project", F.lit(section).alias("section"), key(F.col("_g"), F.col("_i"), slot, F.col("_n")).alias("place"), "line")

    def each(frame, section, group, item, slot, n, line) -> DataFrame:
        return frame.select("project", F.lit(section).alias("section"), key(group, item, slot, n).alias("place"), line.alias("line"))

    def listed(column: Column) -> Column:
        return F.when(F.size(column) > 0, F.array_join(column, ", ")).otherwise("-")

    nothing, first = order_key(), F.lit(0)
    projects = report.endpoints.select("project").union(report.services.select("project")).union(report.models.select("project")).distinct()
    heads = [rows(projects, s, nothing, nothing, 0, t) for s, t in ((0, REPORT_HEAD), (2, REPORT_FLOWS), (4, REPORT_SERVICES), (6, REPORT_MODELS))]

    endpoints = report.endpoints.withColumn("module", file_stem(F.col("ord.path")))
    modules = endpoints.groupBy("project", "module").agg(F.min("ord").alias("start"))
    endpoints = endpoints.join(modules, ["project", "module"])
    start, own = F.col("start"), F.col("ord")
    told = F.array(
        F.lit(""), F.format_string("#### %s %s", "method", "route"), F.lit(""), F.format_string("- **处理函数**: `%s`", "handler"),
        F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("- **描述**: "), "description")),
        F.when(F.col("request_body").isNotNull(), F.format_string("- **请求体**: `%s`", "request_body")),
        F.when(F.size("dependencies") > 0, F.concat(F.lit("- **依赖**: "), F.array_join("dependencies", ", "))),
        F.lit(""), F.lit("**数据流向:**"), F.lit("```"), F.format_string("前端请求 → %s %s", "method", "route"), F.lit(REPORT_ARROW),
        F.format_string("路由处理器: %s()", "handler"))
    flows = report.flows.where("service_call is not null").join(endpoints.select("project", "ord", "start"), ["project", "ord"])
    some = flows.select("project", "ord", "start").distinct()
    # Operations in the order of their markers; there are as many as markers at most.
    operations = flows.groupBy("project", "ord", "start").agg(F.collect_set(F.array_join("db_operations", ",")).alias("_all"))
    named = F.array_intersect(F.array(*[F.lit(op) for _, op in DB_MARKERS]), F.split(F.array_join("_all", ","), ","))
    operations = operations.withColumn("_ops", named).where(F.size("_ops") > 0)
    detail = [
        rows(modules, 3, start, nothing, 0, ["", F.format_string("### %s 模块", "module"), ""]),
        rows(endpoints, 3, start, own, 1, [F.get(F.array_compact(told), F.lit(i)) for i in range(13)]),
        rows(some, 3, start, own, 2, [REPORT_ARROW, "服务层调用:"]),
        each(flows, 3, start, own, 3, F.col("call_no"), F.format_string("      - %s()", "service_call")),
        rows(operations, 3, start, own, 4, [REPORT_ARROW, F.concat(F.lit("数据库操作: "), F.array_join("_ops", ", "))]),
        rows(endpoints, 3, start, own, 5, [REPORT_ARROW, "返回响应", "```"]),
    ]

    classes = report.services.groupBy("project", "class_name").agg(
        F.min("ord").alias("start"), F.min_by("file_path", "ord").alias("file_path"), F.count("*").alias("methods"))
    methods = report.services.join(classes.select("project", "class_name", "start"), ["project", "class_name"])
    shown = F.col("calls") if calls is None else F.slice("calls", 1, calls)
    detail += [
        rows(classes, 5, start, nothing, 0, [
            "", F.format_string("### %s", "class_name"), "", F.format_string("- **文件**: `%s`", "file_path"),
            F.format_string("- **方法数量**: %d", "methods"), *REPORT_METHODS]),
        each(methods, 5, start, own, 1, first, F.format_string("| `%s` | %s | %s |", "name", listed(shown), listed(F.col("db_operations")))),
    ]
    shown = F.col("fields") if fields is None else F.slice("fields", 1, fields)
    field = F.transform(shown, lambda f: F.format_string("  - `%s`: %s", f["name"], F.coalesce(f["type"], f["definition"], F.lit(""))))
    defined = report.models.withColumn("_n_fields", F.size("fields"))
    detail += [
        rows(defined, 7, own, nothing, 0, [
            "", F.format_string("### %s (%s)", "name", "kind"), "", F.format_string("- **文件**: `%s`", "file_path"),
            F.when(F.col("_n_fields") > 0, F.lit("- **字段**:"))]),
        defined.select("project", "ord", F.posexplode(field).alias("_n", "line")).select(
            "project", F.lit(7).alias("section"), key(own, nothing, 1, F.col("_n")).alias("place"), "line"),
    ]
    endpoint = F.format_string("| %s | `%s` | `%s` | %s |", "method", "route", "handler", F.coalesce("description", F.lit("")))
    out = each(endpoints, 1, nothing, own, 0, first, endpoint)
    for part in [*heads, *detail]:
        out = out.unionByName(part)
    return out


def dataflow_graph(routes: DataFrame, services: DataFrame) -> FlowGraph:
    """Nodes front end, routes, services and database of each project, and the edges between them.

    A call leads to every service whose ``Class.method`` contains the called name.
    """
    routes = routes.withColumn("node", F.struct(F.lit("api").alias("layer"), "method", "route"))
    service_key = F.concat_ws(".", "class_name", "name")
    services = services.withColumn("service", service_key)
    projects = routes.select("project").union(services.select("project")).distinct()

    def nodes(frame, level, group, label):
        return frame.select(
            "project", F.lit(level).alias("level"), F.lit(group).alias("group"), label.alias("label")
        ).distinct()

    api_label = F.concat_ws(" ", "method", "route")
    all_nodes = (
        nodes(projects, 0, "frontend", F.lit("🌐 前端"))
        .unionByName(nodes(routes, 1, "api", api_label))
        .unionByName(nodes(services, 2, "service", F.col("service")))
        .unionByName(nodes(projects, 3, "database", F.lit("🗄️ 数据库")))
    )
    asked = routes.select("project", F.explode(F.array_distinct("service_calls")).alias("call")).distinct()
    hits = substring_join(
        services.select("project", "service"), "service", asked, "call", ["project", "service"], on=["project"]
    ).select("project", "service", "call")

    def edges(frame, source, target, label):
        return frame.select("project", source.alias("from"), target.alias("to"), label.alias("label")).distinct()

    uses = routes.select("project", api_label.alias("api"), F.explode("service_calls").alias("call")).distinct()
    all_edges = (
        edges(routes, F.lit("🌐 前端"), api_label, F.lit("请求"))
        .unionByName(edges(uses.join(hits, ["project", "call"]), F.col("api"), F.col("service"), F.lit("调用")))
        .unionByName(
            edges(
                services.where(F.size("db_operations") > 0), F.col("service"), F.lit("🗄️ 数据库"),
                F.array_join("db_operations", ", "),
            )
        )
    )
    return FlowGraph(all_nodes, all_edges)


def dataflow_lines(
    routes: DataFrame, services: DataFrame, shown: int | None = None, calls: int | None = None
) -> DataFrame:
    """Mermaid diagram of routes and services, all or the first ``shown`` per project and ``calls`` per
    route: (project, section, line_no, line)."""
    limit = F.lit(True) if shown is None else F.col("n") < shown
    first = dense_index(routes, ["project", "ord"], "n", within="project").where(limit).withColumnRenamed("n", "i")
    tools = dense_index(services, ["project", "ord"], "n", within="project").where(limit).withColumnRenamed("n", "j")
    projects = routes.select("project").union(services.select("project")).distinct()
    head = F.array(*[F.lit(t) for t in (
        "graph LR", "    classDef frontend fill:#61dafb,stroke:#21a0c4,color:black",
        "    classDef api fill:#4CAF50,stroke:#388E3C,color:white",
        "    classDef service fill:#2196F3,stroke:#1565C0,color:white",
        "    classDef database fill:#FF9800,stroke:#F57C00,color:white", "",
        '    Frontend["🌐 前端"]:::frontend',
    )])

    def rows(frame, section, number, line):
        return frame.select(
            "project", F.lit(section).alias("section"), number.cast("bigint").alias("line_no"), line.alias("line")
        )

    def pairs(frame, section, number, *lines):
        exploded = frame.select("*", F.posexplode(F.array(*lines)).alias("_k", "line"))
        return rows(exploded, section, number * len(lines) + F.col("_k"), F.col("line"))

    named = F.col("service_calls") if calls is None else F.slice("service_calls", 1, calls)
    wanted = first.select("project", "i", F.explode(F.array_distinct(named)).alias("call"))
    keys = tools.select("project", "j", F.concat_ws(".", "class_name", "name").alias("service"))
    hits = substring_join(
        keys, "service", wanted.select("project", "call").distinct(), "call", ["project", "j"], on=["project"])
    links = wanted.join(hits.select("project", "j", "call"), ["project", "call"]).select("project", "i", "j").distinct()
    return (
        pairs(projects, 0, F.lit(0), *[F.get(head, F.lit(k)) for k in range(7)])
        .unionByName(pairs(
            first, 1, F.col("i"), F.format_string('    API_%d["%s %s"]:::api', "i", "method", "route"),
            F.format_string("    Frontend --> API_%d", "i"),
        ))
        .unionByName(rows(tools, 2, F.col("j"), F.format_string('    SVC_%d["%s.%s"]:::service', "j", "class_name", "name")))
        .unionByName(rows(links, 3, F.shiftleft("i", 32) + F.col("j"), F.format_string("    API_%d --> SVC_%d", "i", "j")))
        .unionByName(rows(projects, 4, F.lit(0), F.lit('    DB[("🗄️ 数据库")]:::database')))
        .unionByName(rows(tools, 5, F.col("j"), F.format_string("    SVC_%d --> DB", "j")))
    )
