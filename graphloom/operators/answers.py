"""Templated answers to batches of questions.

Questions are (project, question_id, question). Answers are line rows
(project, question_id, intent, line_no, ord, line): an answer that lists many
names has one row per name instead of one long string. The names of a type are the same for
all who ask, so those rows stand once per project and intent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.grams import phrase_join
from graphloom.functions.ordered import top_per
from graphloom.graph import Graph
from graphloom.operators.lookup import find_dependencies, find_related, search_keywords
from graphloom.schema import QUESTION_KEYWORDS, order_key
from graphloom.session import cut

_ID = ["project", "question_id"]

# --- fixed values: answer texts --------------------------------------------
LISTS = {  # intent: (entity type, heading, answer when there is none)
    "tech": ("Framework", "项目技术栈:", None),
    "databases": ("Database", "项目使用的数据库:", "项目中没有发现数据库信息。"),
    "tools": ("Tool", "项目使用的工具:", "项目中没有发现工具信息。"),
    "modules": ("Module", "项目包含以下模块:", "项目中没有发现模块信息。"),
    "documents": ("Document", "项目包含以下文档:", "项目中没有发现文档信息。"),
}
UNKNOWN_ENTITY = "抱歉，我找不到相关的实体信息。"
UNKNOWN_DEPENDENCY = "抱歉，我找不到相关的依赖信息。"
UNKNOWN_QUESTION = "抱歉，我无法回答这个问题。请尝试更具体的问题，例如:"
EXAMPLES = ["  - 有哪些模块?", "  - 技术栈是什么?", "  - 使用了哪些数据库?"]
SUBHEADINGS = {"tech": ["", "框架:"]}
# --- end of fixed values ----------------------------------------------------


def route(question: Column, case_insensitive: bool = False) -> Column:
    """Intent of a question: the first keyword group with a hit, else general."""
    text = F.lower(question) if case_insensitive else question
    intent = None
    for name, words in QUESTION_KEYWORDS:
        hit = F.contains(text, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(text, F.lit(word))
        intent = F.when(hit, name) if intent is None else intent.when(hit, name)
    return intent.otherwise("general")


def route_questions(questions: DataFrame, case_insensitive: bool = False) -> DataFrame:
    return questions.withColumn("intent", route(F.col("question"), case_insensitive))


def link_entities(questions: DataFrame, graph: Graph) -> DataFrame:
    """The entity each question names: the longest name, then the earliest entity."""
    names = graph.entities.where(F.length("name") >= 2).select(
        "project", "name", "type", "description", "ord", F.lower("name").alias("key")
    )
    texts = questions.select(*_ID, F.lower("question").alias("text"))
    pairs = phrase_join(texts, "text", names, "key", _ID, on=["project"])
    best = pairs.groupBy(*_ID).agg(
        F.min_by(
            F.struct("name", "type", "description"), F.struct(-F.length("name"), "ord")
        ).alias("e")
    )
    return best.select(*_ID, "e.*")


def _lines(rows: DataFrame, line_no: int, line: Column, ord_: Column | None = None) -> DataFrame:
    return rows.select(
        *_ID, "intent", F.lit(line_no).alias("line_no"),
        (order_key() if ord_ is None else ord_).alias("ord"), line.alias("line"),
    )


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _linked(asked: DataFrame, graph: Graph, linked: DataFrame | None) -> DataFrame:
    """Questions with the entity they name, written once, as every part of an answer reads it."""
    return cut(asked.join(link_entities(asked, graph) if linked is None else linked, _ID))


def _names_of(linked: DataFrame) -> DataFrame:
    return linked.select("project", "name").distinct()


def answer_what_is(
    routed: DataFrame, graph: Graph, related_shown: int | None = None, linked: DataFrame | None = None
) -> DataFrame:
    """Type, description and related names, a line each, of the entity asked about."""
    asked = routed.where("intent = 'what_is'").select(*_ID, "intent", "question")
    linked = _linked(asked, graph, linked)
    related = find_related(graph, _names_of(linked)).select("project", F.col("asked").alias("name"), "entity", "ord")
    shown = top_per(related, ["project", "name"], ["ord"], related_shown)
    return _stack([
        _lines(linked, 0, F.format_string("%s 是项目中的 %s。", "name", "type")),
        _lines(linked.where("coalesce(description, '') <> ''"), 1, F.concat(F.lit("描述: "), "description")),
        _lines(linked.join(shown, ["project", "name"]), 2, F.concat(F.lit("相关实体: "), "entity"), F.col("ord")),
        _lines(asked.join(linked, _ID, "left_anti"), 0, F.lit(UNKNOWN_ENTITY)),
    ])


def answer_dependencies(routed: DataFrame, graph: Graph, linked: DataFrame | None = None) -> DataFrame:
    """Dependencies of the entity asked about, one line each."""
    asked = routed.where("intent = 'dependencies'").select(*_ID, "intent", "question")
    linked = _linked(asked, graph, linked)
    needs = find_dependencies(graph, _names_of(linked)).select(
        "project", F.col("asked").alias("name"), "entity", "ord"
    )
    some = linked.join(needs.select("project", "name").distinct(), ["project", "name"], "left_semi")
    none = linked.join(needs, ["project", "name"], "left_anti")
    return _stack([
        _lines(some, 0, F.concat("name", F.lit(" 依赖于:"))),
        _lines(linked.join(needs, ["project", "name"]), 1, F.concat(F.lit("  - "), "entity"), F.col("ord")),
        _lines(none, 0, F.concat("name", F.lit(" 没有发现依赖关系。"))),
        _lines(asked.join(linked, _ID, "left_anti"), 0, F.lit(UNKNOWN_DEPENDENCY)),
    ])


def answer_list(routed: DataFrame, graph: Graph, intent: str) -> DataFrame:
    """Whether the project has names of one type; the names are in ``answer_lists``, once per project and intent."""
    type_, heading, nothing = LISTS[intent]
    asked = routed.where(F.col("intent") == intent).select(*_ID, "intent")
    known = graph.entities.where(F.col("type") == type_).select("project").distinct()
    answered, empty = asked.join(known, "project", "left_semi"), asked.join(known, "project", "left_anti")
    return _stack([
        _lines(answered, 0, F.lit(heading)),
        *[_lines(answered, 0, F.lit(text), order_key(pos=i + 1)) for i, text in enumerate(SUBHEADINGS.get(intent, []))],
        _lines(empty, 0, F.lit(heading if nothing is None else nothing)),
    ])


def answer_lists(graph: Graph, shown: int | None = None) -> DataFrame:
    """(project, intent, line_no, ord, line): what the list answers of a project enumerate, whoever asks."""
    def lines(intent, type_):
        rows = graph.entities.where(F.col("type") == type_).select("project", "name", "ord")
        return top_per(rows, ["project"], ["ord"], shown).select(
            "project", F.lit(intent).alias("intent"), F.lit(1).alias("line_no"), "ord",
            F.concat(F.lit("  - "), "name").alias("line"),
        )

    return _stack([lines(intent, type_) for intent, (type_, _, _) in LISTS.items()])


def answer_general(routed: DataFrame, graph: Graph, shown: int | None = None) -> DataFrame:
    """Entities that mention the whole question, all or the first ``shown``."""
    asked = routed.where("intent = 'general'").select(*_ID, "intent", "question")
    hits = search_keywords(graph, asked.select("project", F.col("question").alias("keyword")))
    few = cut(top_per(hits, ["project", "keyword"], ["ord"], shown).select(
        "project", F.col("keyword").alias("question"), "name", "type", "source_file", "ord"
    ))
    known = few.select("project", "question").distinct()
    line = F.concat(
        F.format_string("  - %s (%s)", "name", "type"),
        F.when(F.coalesce("source_file", F.lit("")) != "", F.format_string(" [来源: %s]", "source_file")).otherwise(""),
    )
    on = ["project", "question"]
    return _stack([
        _lines(asked.join(known, on, "left_semi"), 0, F.lit("找到相关实体:")),
        _lines(asked.join(few, on), 1, line, F.col("ord")),
        *[_lines(asked.join(known, on, "left_anti"), i, F.lit(text)) for i, text in enumerate([UNKNOWN_QUESTION, *EXAMPLES])],
    ])


def answer(questions: DataFrame, graph: Graph, case_insensitive: bool = False) -> DataFrame:
    """Route every question and answer it. Names that an answer enumerates are in ``answer_lists``."""
    routed = route_questions(questions, case_insensitive)
    linked = cut(link_entities(routed.where("intent in ('what_is', 'dependencies')"), graph))
    return _stack(
        [answer_what_is(routed, graph, linked=linked), answer_dependencies(routed, graph, linked), answer_general(routed, graph)]
        + [answer_list(routed, graph, intent) for intent in LISTS]
    )
