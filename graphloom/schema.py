"""Column layouts, type domains and the fixed word lists of the rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# --- fixed values -----------------------------------------------------------
# Type domains, lexicon, stop terms, name filters and file rules. Results depend
# on these literally, so they are stated here once, in full.

ENTITY_TYPES = [
    "Project", "Module", "Service", "Protocol", "Skill", "Framework", "Database",
    "Tool", "API", "Configuration", "Command", "Feature", "Document",
]
RELATION_TYPES = [
    "depends_on", "supports", "uses", "contains", "implements", "extends",
    "connects_to", "calls", "references", "documents", "belongs_to",
]
# Types a model response may use: every entity type but Skill.
RESPONSE_ENTITY_TYPES = [t for t in ENTITY_TYPES if t != "Skill"]

LEXICON = {
    "Framework": [
        "python", "javascript", "typescript", "react", "vue", "angular", "nodejs", "node.js",
        "fastapi", "flask", "django", "express", "spring", "pandas", "spark",
    ],
    "Database": ["postgres", "postgresql", "mysql", "redis", "mongodb", "sqlite", "elasticsearch"],
    "Tool": ["docker", "kubernetes", "k8s", "kafka", "nginx", "terraform"],
    "Protocol": ["http", "https", "grpc", "websocket", "rest", "restful"],
}

STOP_TERMS = [
    "项目概述", "项目简介", "概述", "简介", "介绍", "核心模块", "主要功能", "功能特性", "特性",
    "技术栈", "技术架构", "架构", "架构设计", "快速开始", "快速入门", "开始使用", "上手",
    "安装指南", "安装", "部署", "安装方式", "安装步骤", "文档", "参考资料", "链接", "文档列表",
    "贡献指南", "参与贡献", "贡献", "许可证", "license", "许可", "更新日志", "changelog",
    "目录", "table of contents", "系统架构", "系统要求", "核心组件", "组件",
    "数据流", "处理模式", "容错机制", "扩展性", "水平扩展", "垂直扩展",
    "配置管理", "配置", "配置说明", "配置文件", "5分钟上手",
    "第一步", "第二步", "第三步", "第四步", "第五步", "第六步", "下一步", "查看结果", "验证安装",
    "故障排除", "常见问题", "升级", "依赖安装", "可选依赖", "核心依赖", "完整依赖",
    "示例", "例子", "基础端点", "内置", "自定义",
]
COMMAND_PREFIXES = ["dataflow", "taskflow"]
SKIPPED_IMPORTS = [
    "os", "sys", "re", "json", "typing", "abc", "dataclasses", "csv", "psycopg2", "kafka",
]
PLAIN_PARENTS = ["ABC", "object", "BaseModel"]

CODE_EXTENSIONS = ["py", "js", "ts", "jsx", "tsx", "java", "go", "rs", "rb", "c", "cpp", "h"]
FLOW_EXTENSIONS = ["py", "js", "ts", "java", "go"]
FRONTEND_EXTENSIONS = ["js", "ts", "jsx", "tsx", "vue"]
IGNORED_DIRECTORIES = [
    ".git", "node_modules", "__pycache__", "venv", ".venv", "dist", "build", "output",
]
WATCHED_EXTENSIONS = ["py", "js", "ts", "md", "json", "yaml", "yml"]
WATCH_IGNORED = ["__pycache__", ".git", "node_modules", ".venv", "venv", "output", ".mimocode"]

NOT_CALLS = ["if", "for", "while", "return", "print", "len", "str", "int", "list", "dict", "set"]
FILTERED_CALLS = NOT_CALLS + [
    "raise", "HTTPException", "None", "True", "False",
    "close", "commit", "cursor", "execute", "fetchall", "fetchone",
    "encode", "decode", "hexdigest", "sha256", "connect",
    "append", "extend", "remove", "pop", "insert",
    "get", "post", "put", "delete", "patch",
    "json", "strip", "split", "join", "replace", "format",
    "keys", "values", "items", "update", "upper", "lower", "capitalize", "title",
    "isdigit", "isalpha", "isalnum",
]
NOT_SERVICE_CALLS = NOT_CALLS + ["True", "False", "None"]
DB_MARKERS = [
    (".query(", "QUERY"), (".add(", "INSERT"), (".delete(", "DELETE"), (".commit(", "COMMIT"),
    (".execute(", "EXECUTE"), (".filter(", "FILTER"), (".filter_by(", "FILTER_BY"),
    (".first(", "SELECT_ONE"), (".all(", "SELECT_ALL"), (".update(", "UPDATE"),
]
QUESTION_KEYWORDS = [
    ("tech", ["技术栈", "tech", "technology"]),
    ("databases", ["数据库", "database", "db"]),
    ("tools", ["工具", "tool"]),
    ("modules", ["模块", "module", "组件", "component"]),
    ("documents", ["文档", "document", "doc"]),
    ("dependencies", ["依赖", "depend", "需要", "require"]),
    ("what_is", ["是什么", "what is", "介绍", "explain"]),
]
# --- end of fixed values ----------------------------------------------------

# Position of a row in its graph: struct fields compare left to right, so
# min_by(row, ord) is "first wins" and max_by(row, ord) is "last wins".
ORD = T.StructType([
    T.StructField("gen", T.IntegerType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("rule", T.IntegerType()),
    T.StructField("pat", T.IntegerType()),
    T.StructField("pos", T.LongType()),
])
ENTITY = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("ord", ORD),
])
RELATION = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("ord", ORD),
])
FILE = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("ext", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("content_hash", T.StringType()),
])


def order_key(kind=0, path="", rule=0, pat=0, pos=0, gen=0) -> Column:
    """The ``ord`` struct; arguments are columns or plain values."""

    def part(value, name, dtype):
        value = value if isinstance(value, Column) else F.lit(value)
        return value.cast(dtype).alias(name)

    return F.struct(
        part(gen, "gen", "int"), part(kind, "kind", "int"), part(path, "path", "string"),
        part(rule, "rule", "int"), part(pat, "pat", "int"), part(pos, "pos", "bigint"),
    )
