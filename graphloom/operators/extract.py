"""Rules that turn files into entities and relations.

Every rule is an array expression over one file, so all rules of all files are
two projections and one explode over a single scan; nothing is shuffled until the
rows are deduplicated. What entities and relations of a rule have in common (the places it finds
in the text) is a column of the first projections, so a text is searched once for both.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.grams import substring_join
from graphloom.functions.text import (
    all_matches, base_name, blank_to_null, contains_any, first_line, lines, strip,
)
from graphloom.graph import Graph
from graphloom.operators.dedupe import dedupe_entities, dedupe_relations, infer_relations
from graphloom.schema import (
    COMMAND_PREFIXES, LEXICON, PLAIN_PARENTS, SKIPPED_IMPORTS, STOP_TERMS, order_key,
)
from graphloom.session import cut
from graphloom.sources.tree import document_title

# --- fixed values: what the rules look for ----------------------------------
ENDPOINT_PATTERNS = [
    r"(?iU)[-*]\s+`(GET|POST|PUT|DELETE|PATCH)\s+([^`]+)`\s*[-–—]?\s*([^\n]*)",
    r"(?iU)[-*]\s+\*\*(GET|POST|PUT|DELETE|PATCH)\s+([^*]+)\*\*\s*[-–—]?\s*([^\n]*)",
    r"(?iU)`(GET|POST|PUT|DELETE|PATCH)\s+(/[^`]+)`()",
]
FENCE_PATTERNS = ["(?s)```bash\n(|.*?\n)```", "(?s)```\n(|.*?\n)```"]
LISTED_PATTERNS = [
    r"(?U)[-*]\s+\*\*(\w+)\*\*\s*[-–—]", r"(?U)[-*]\s+\*\*(\w+)\*\*", r"(?U)`(\w+)`\s*[-–—]",
]
DOCSTRING_PATTERN = r'(?s)"""(.*?)"""'
CLASS_PATTERN = r'(?sU)class\s+(\w+)\s*(?:\(([^)]*)\))?:\s*\n\s*(?:"""(.*?)""")?'
FUNCTION_PATTERN = r'(?sU)def\s+(\w+)\s*\([^)]*\)\s*(?:->[^:]+)?:\s*\n\s*(?:"""(.*?)""")?'
IMPORT_PATTERN = r"(?U)(?:from|import)\s+([\w.]+)"
# --- end of fixed values ----------------------------------------------------

_TEXT = "string"
ENTITY_FACT = "array<struct<name:string,type:string,description:string,rule:int,pat:int,pos:bigint>>"
RELATION_FACT = "array<struct<source:string,target:string,type:string,rule:int,pat:int,pos:bigint>>"


def _entity(name, type_, description=None, rule=0, pat=0, pos=0) -> Column:
    return F.struct(
        name.alias("name"), F.lit(type_).alias("type"),
        (F.lit(None) if description is None else description).cast(_TEXT).alias("description"),
        F.lit(rule).alias("rule"), F.lit(pat).alias("pat"),
        (pos if isinstance(pos, Column) else F.lit(pos)).cast("bigint").alias("pos"),
    )


def _relation(source, target, type_, rule=0, pat=0, pos=0) -> Column:
    return F.struct(
        source.alias("source"), target.alias("target"), F.lit(type_).alias("type"),
        F.lit(rule).alias("rule"), F.lit(pat).alias("pat"),
        (pos if isinstance(pos, Column) else F.lit(pos)).cast("bigint").alias("pos"),
    )


# --- documents --------------------------------------------------------------


def document_rule(title: Column, path: Column) -> tuple[Column, Column | None]:
    """The document itself."""
    return F.array(_entity(title, "Document", F.concat(F.lit("文档: "), path))), None


def mention_hits(lowered: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """Lexicon terms that occur anywhere in the lower-cased text."""
    terms = [(term, kind) for kind, names in lexicon.items() for term in names]
    return F.array_compact(
        F.array(*[
            F.when(F.contains(lowered, F.lit(term)), _entity(F.lit(term), kind, rule=1, pos=i))
            for i, (term, kind) in enumerate(terms)
        ])
    )


def mention_rule(found: Column, title: Column):
    """Lexicon terms of ``mention_hits``, and who uses them."""
    uses = F.transform(found, lambda e: _relation(title, e["name"], "uses", 1, 0, e["pos"]))
    return found, uses


def endpoint_hits(content: Column) -> list[Column]:
    """Endpoints written as Markdown bullets or in backticks, by pattern."""
    return [
        F.transform(
            all_matches(content, pattern, {"method": 1, "path": 2, "desc": 3}),
            lambda h: F.struct(
                F.upper(h["method"]).alias("method"), strip(h["path"]).alias("path"),
                strip(h["desc"]).alias("desc"),
            ),
        )
        for pattern in ENDPOINT_PATTERNS
    ]


def endpoint_rule(found: Sequence[Column], title: Column):
    """Endpoints of ``endpoint_hits``."""

    def one(pat: int, hits: Column):
        return (
            F.transform(
                hits,
                lambda h, i: _entity(
                    h["path"], "API",
                    F.concat(h["method"], F.lit(" "), h["path"], F.lit(" - "), h["desc"]), 2, pat, i,
                ),
            ),
            F.transform(hits, lambda h, i: _relation(title, h["path"], "contains", 2, pat, i)),
        )

    sides = [one(pat, hits) for pat, hits in enumerate(found)]
    return F.concat(*[e for e, _ in sides]), F.concat(*[r for _, r in sides])


def command_rule(content: Column, prefixes: Sequence[str]):
    """Command lines inside shell or plain fences."""
    starts = "^(?:" + "|".join(rf"\Q{p}\E" for p in prefixes) + ") "

    def one(pat: int, pattern: str):
        def commands(block, b):
            numbered = F.transform(
                lines(strip(block)), lambda line, i: F.struct(i.alias("i"), strip(line).alias("line"))
            )
            return F.transform(
                F.filter(numbered, lambda n: n["line"].rlike(starts)),
                lambda n: _entity(
                    F.array_join(F.slice(F.split(n["line"], r"(?U)\s+"), 1, 2), " "), "Command",
                    F.concat(F.lit("命令: "), n["line"]), 3, pat,
                    b.cast("bigint") * 1_000_000 + n["i"],
                ),
            )

        blocks = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
        return F.flatten(F.transform(blocks, commands))

    return F.concat(*[one(pat, pattern) for pat, pattern in enumerate(FENCE_PATTERNS)]), None


def heading_hits(content: Column, stop_terms: Sequence[str]) -> Column:
    """Second-level headings."""
    # A section is a '#' line with what follows up to the next '#' line. A heading
    # with nothing under it borrows the text of the next section.
    sections = F.split(content, "\n(?=#)")
    pairs = F.arrays_zip(sections.alias("own"), F.slice(sections, 2, 1 << 30).alias("next"))
    numbered = F.transform(
        pairs,
        lambda p, i: F.struct(
            i.alias("i"), p["own"].alias("text"),
            strip(F.substring(F.substring_index(p["own"], "\n", 1), 4, 1 << 30)).alias("name"),
            F.when(F.contains(p["own"], F.lit("\n")), p["own"]).otherwise(p["next"]).alias("body"),
        ),
    )
    return F.filter(
        numbered,
        lambda h: F.startswith(h["text"], F.lit("## "))
        & (F.length(h["name"]) > 2)
        & ~contains_any(F.lower(h["name"]), list(stop_terms)),
    )


def heading_rule(kept: Column, title: Column):
    """Headings of ``heading_hits`` as modules, described by their first line of text."""

    def description(h):
        after = F.transform(lines(F.substring_index(h["body"], "\n", -1 << 30)), strip)
        text = F.filter(
            F.slice(after, 2, 1 << 30), lambda line: (line != "") & ~line.rlike("^(?:#|```)")
        )
        return F.try_element_at(text, F.lit(1))

    return (
        F.transform(kept, lambda h: _entity(h["name"], "Module", description(h), 4, 0, h["i"])),
        F.transform(kept, lambda h: _relation(title, h["name"], "contains", 4, 0, h["i"])),
    )


def listed_hits(content: Column, stop_terms: Sequence[str]) -> list[Column]:
    """Names in bold bullets or in backticks followed by a dash, by pattern."""
    return [
        F.filter(
            F.transform(
                F.regexp_extract_all(content, F.lit(pattern), F.lit(1)),
                lambda n, i: F.struct(i.alias("i"), n.alias("name")),
            ),
            lambda n: (F.length(n["name"]) > 2) & ~contains_any(F.lower(n["name"]), list(stop_terms)),
        )
        for pattern in LISTED_PATTERNS
    ]


def listed_rule(found: Sequence[Column], title: Column):
    """Names of ``listed_hits``."""

    def one(pat: int, kept: Column):
        return (
            F.transform(kept, lambda n: _entity(n["name"], "Module", None, 5, pat, n["i"])),
            F.transform(kept, lambda n: _relation(title, n["name"], "documents", 5, pat, n["i"])),
        )

    sides = [one(pat, kept) for pat, kept in enumerate(found)]
    return F.concat(*[e for e, _ in sides]), F.concat(*[r for _, r in sides])


# --- code -------------------------------------------------------------------


def module_name(path: Column) -> Column:
    return F.replace(base_name(path), F.lit(".py"), F.lit(""))


def module_rule(content: Column, path: Column):
    """The file as a module, described by its first docstring."""
    doc = blank_to_null(first_line(F.regexp_extract(content, DOCSTRING_PATTERN, 1)))
    return F.array(_entity(module_name(path), "Module", F.coalesce(doc, F.concat(F.lit("模块: "), path)))), None


def class_hits(content: Column) -> Column:
    return all_matches(content, CLASS_PATTERN, {"name": 1, "parents": 2, "doc": 3})


def class_rule(hits: Column, path: Column):
    """Classes of ``class_hits``, the file that contains them and what they extend."""
    entities = F.transform(
        hits,
        lambda h, i: _entity(
            h["name"], "Module",
            F.when(h["doc"] != "", first_line(h["doc"])).otherwise(F.concat(F.lit("类: "), h["name"])),
            1, 0, i,
        ),
    )

    def edges(h, i):
        parents = strip(h["parents"])
        contains = _relation(module_name(path), h["name"], "contains", 1, 0, 2 * i)
        extends = _relation(h["name"], parents, "extends", 1, 0, 2 * i + 1)
        plain = (h["parents"] == "") | parents.isin(PLAIN_PARENTS)
        return F.when(plain, F.array(contains)).otherwise(F.array(contains, extends))

    return entities, F.flatten(F.transform(hits, edges))


def function_rule(content: Column):
    """Public functions as features."""
    hits = all_matches(content, FUNCTION_PATTERN, {"name": 1, "doc": 2})
    numbered = F.transform(hits, lambda h, i: F.struct(i.alias("i"), h.alias("h")))
    kept = F.filter(numbered, lambda n: ~F.startswith(n["h"]["name"], F.lit("_")))
    return (
        F.transform(
            kept,
            lambda n: _entity(
                n["h"]["name"], "Feature",
                F.when(n["h"]["doc"] != "", first_line(n["h"]["doc"])), 2, 0, n["i"],
            ),
        ),
        None,
    )


def import_rule(content: Column, path: Column, skipped: Sequence[str], drop_blank_targets: bool):
    """Modules named after ``from`` or ``import``."""
    names = F.transform(
        F.regexp_extract_all(content, F.lit(IMPORT_PATTERN), F.lit(1)),
        lambda n, i: F.struct(i.alias("i"), F.substring_index(n, ".", 1).alias("name")),
    )

    def wanted(n):
        keep = ~n["name"].isin(list(skipped)) & ~F.startswith(n["name"], F.lit("__"))
        return keep & (n["name"] != "") if drop_blank_targets else keep

    return None, F.transform(
        F.filter(names, wanted),
        lambda n: _relation(module_name(path), n["name"], "depends_on", 3, 0, n["i"]),
    )


# --- all rules over files ---------------------------------------------------

DOCUMENT_RULES = ("document", "mention", "endpoint", "command", "heading", "listed")
CODE_RULES = ("module", "class", "function", "import")


def _side(rules: Sequence[tuple], side: int) -> Column:
    """One side (entities or relations) of several rules as a single array."""
    schema = (ENTITY_FACT, RELATION_FACT)[side]
    arrays = [r[side].cast(schema) for r in rules if r[side] is not None]
    return F.concat(*arrays) if arrays else F.array().cast(schema)


def _graph(files: DataFrame, entities: Column, relations: Column) -> Graph:
    """Explode the rules' arrays into entity rows and relation rows."""
    path = F.col("path")
    kind = F.when(F.col("kind") == "md", 0).otherwise(1)
    ord_ = order_key(kind, path, F.col("f.rule"), F.col("f.pat"), F.col("f.pos")).alias("ord")
    source = path.alias("source_file")
    return Graph(
        files.select("project", "path", "kind", F.explode(entities).alias("f")).select(
            "project", "f.name", "f.type", "f.description", source, ord_
        ),
        files.select("project", "path", "kind", F.explode(relations).alias("f")).select(
            "project", "f.source", "f.target", "f.type",
            F.lit(None).cast(_TEXT).alias("description"), source, ord_,
        ),
    )


# What a rule finds in a text, as columns beside it.
Hits = dict[str, Column]


def _read(files: DataFrame, title_fallback: str, hits: Hits) -> DataFrame:
    """The files with their titles and what the rules found in them."""
    is_document = F.col("kind") == "md"
    title = document_title(F.col("content"), F.col("path"), title_fallback)
    titled = files.select(
        "project", "path", "ext", "kind", "content", F.when(is_document, title).alias("title"),
        F.when(is_document, F.lower("content")).alias("_lowered"),
    )
    return titled.select(*titled.columns, *[found.alias(name) for name, found in hits.items()])


def _document_rules(
    rules: Sequence[str] = DOCUMENT_RULES,
    lexicon: Mapping[str, Sequence[str]] = LEXICON,
    stop_terms: Sequence[str] = tuple(STOP_TERMS),
    command_prefixes: Sequence[str] = tuple(COMMAND_PREFIXES),
) -> tuple[list[tuple], Hits]:
    content, path, title = F.col("content"), F.col("path"), F.col("title")
    hits: Hits = {}

    def once(name: str, found: Column) -> Column:
        hits[name] = F.when(F.col("kind") == "md", found)
        return F.col(name)

    def each(name: str, found: Sequence[Column]) -> list[Column]:
        return [once(f"{name}{i}", f) for i, f in enumerate(found)]

    available = {
        "document": lambda: document_rule(title, path),
        "mention": lambda: mention_rule(once("_mentions", mention_hits(F.col("_lowered"), lexicon)), title),
        "endpoint": lambda: endpoint_rule(each("_endpoints", endpoint_hits(content)), title),
        "command": lambda: command_rule(content, command_prefixes),
        "heading": lambda: heading_rule(once("_headings", heading_hits(content, stop_terms)), title),
        "listed": lambda: listed_rule(each("_listed", listed_hits(content, stop_terms)), title),
    }
    return [available[r]() for r in rules], hits


def _code_rules(
    rules: Sequence[str] = CODE_RULES,
    skipped_imports: Sequence[str] = tuple(SKIPPED_IMPORTS),
    drop_blank_targets: bool = False,
) -> tuple[list[tuple], Hits]:
    content, path = F.col("content"), F.col("path")
    classes = F.when(F.col("kind") == "md", F.lit(None)).otherwise(class_hits(content))
    available = {
        "module": lambda: module_rule(content, path),
        "class": lambda: class_rule(F.col("_classes"), path),
        "function": lambda: function_rule(content),
        "import": lambda: import_rule(content, path, skipped_imports, drop_blank_targets),
    }
    return [available[r]() for r in rules], {"_classes": classes} if "class" in rules else {}


def extract_documents(files: DataFrame, title_fallback: str = "Untitled", **options) -> Graph:
    """Raw rows of the document rules, duplicates kept.

    Options: ``rules``, ``lexicon``, ``stop_terms``, ``command_prefixes``.
    """
    rules, hits = _document_rules(**options)
    documents = _read(files.where("kind = 'md'"), title_fallback, hits)
    return _graph(documents, _side(rules, 0), _side(rules, 1))


def extract_code(files: DataFrame, extensions: Sequence[str] | None = None, **options) -> Graph:
    """Raw rows of the code rules; ``extensions`` limits them to some languages.

    Options: ``rules``, ``skipped_imports``, ``drop_blank_targets``.
    """
    rules, hits = _code_rules(**options)
    code = files.where("kind = 'code'")
    if extensions is not None:
        code = code.where(F.col("ext").isin(list(extensions)))
    code = code.select("*", *[found.alias(name) for name, found in hits.items()])
    return _graph(code, _side(rules, 0), _side(rules, 1))


def extract_raw(
    files: DataFrame, title_fallback: str = "Untitled", documents: Mapping = {}, code: Mapping = {}
) -> Graph:
    """All rules over all files in one pass per side, duplicates kept."""
    (d, found), (c, classes) = _document_rules(**documents), _code_rules(**code)
    is_document = F.col("kind") == "md"
    sides = [F.when(is_document, _side(d, i)).otherwise(_side(c, i)) for i in (0, 1)]
    return _graph(_read(files, title_fallback, found | classes), *sides)


def extract_facts(
    files: DataFrame, title_fallback: str = "Untitled", documents: Mapping = {}, code: Mapping = {}
) -> DataFrame:
    """Entities and relations of all rules as one frame, from a single pass over the files.

    Write it, then take the graph from it with graph_of_facts; the files are not read again.
    """
    (d, found), (c, classes) = _document_rules(**documents), _code_rules(**code)
    is_document = F.col("kind") == "md"

    def tagged(side: int, fact: Column) -> Column:
        fields = {"name": 0, "source": 1, "target": 1, "type": None, "description": 0, "rule": None, "pat": None, "pos": None}
        return F.struct(F.lit(side).alias("side"), *[
            (fact[f] if only in (None, side) else F.lit(None).cast(_TEXT)).alias(f) for f, only in fields.items()
        ])

    def both_kinds(side: int) -> Column:
        arrays = F.when(is_document, _side(d, side)).otherwise(_side(c, side))
        return F.transform(arrays, lambda fact: tagged(side, fact))

    facts = F.concat(both_kinds(0), both_kinds(1))
    path = F.col("path")
    kind = F.when(is_document, 0).otherwise(1)
    read = _read(files, title_fallback, found | classes)
    return read.select("project", "path", "kind", F.explode(facts).alias("f")).select(
        "project", "f.side", "f.name", "f.source", "f.target", "f.type", "f.description", path.alias("source_file"),
        order_key(kind, path, F.col("f.rule"), F.col("f.pat"), F.col("f.pos")).alias("ord"),
    )


def graph_of_facts(facts: DataFrame) -> Graph:
    """The raw graph in extract_facts rows."""
    return Graph.of(facts.where("side = 0"), facts.where("side = 1"))


def extract_graph(files: DataFrame, infer: bool = True, once: bool = True, **options) -> Graph:
    """The graph of the files: all rules, first duplicate kept, relations inferred.

    ``once`` writes the raw rows to the checkpoint folder, so that entities and
    relations together read every file a single time.
    """
    raw = graph_of_facts(cut(extract_facts(files, **options))) if once else extract_raw(files, **options)
    graph = Graph(dedupe_entities(raw.entities), dedupe_relations(raw.relations))
    return infer_relations(graph) if infer else graph


def mention_lookup(documents: DataFrame, lexicon: DataFrame, match: str = "substring") -> Graph:
    """Mentions against a lexicon of any size: (term, type, pos), terms lower case.

    ``substring`` finds a term anywhere in the text, ``token`` only as a whole word.
    Documents are (project, path, title, content).
    """
    texts = documents.select("project", "path", "title", F.lower("content").alias("text"))
    if match == "token":
        words = texts.select(
            "project", "path", "title",
            F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)[\w.]+"), F.lit(0)))).alias("term"),
        )
        hits = words.join(lexicon, "term")
    else:
        hits = substring_join(texts, "text", lexicon, "term", ["project", "path"])
    ord_ = order_key(0, F.col("path"), 1, 0, F.col("pos")).alias("ord")
    none = F.lit(None).cast(_TEXT).alias("description")
    return Graph.of(
        hits.select("project", F.col("term").alias("name"), "type", none, F.col("path").alias("source_file"), ord_),
        hits.select(
            "project", F.col("title").alias("source"), F.col("term").alias("target"),
            F.lit("uses").alias("type"), none, F.col("path").alias("source_file"), ord_,
        ),
    )
