"""Syllabus trees: flatten the JSON documents, count questions per node, and nest rows back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provalake import schemas
from provalake.functions.once import let
from provalake.functions.text import normalize_discipline, normalize_name, not_blank
from provalake.operators.matching import lookup_counts
from provalake.session import cut_lineage

#: Item levels that one typed expression reads; documents with more go through a walk of the document.
MAX_DEPTH = 6
_NODE = ("struct<node_path:array<int>,depth:int,disciplina:string,item_id:string,texto:string,full_path:string,"
         "parent_path:string>")


def parsed(taxonomy: Column, max_depth: int = MAX_DEPTH) -> Column:
    return F.from_json(taxonomy, schemas.taxonomy_type(max_depth))


def disciplines(taxonomy: Column) -> Column:
    """Discipline names in document order, blanks dropped; empty for a missing document."""
    doc = F.from_json(taxonomy, "struct<disciplinas:array<struct<nome:string>>>")
    names = F.transform(doc["disciplinas"], lambda d: d["nome"])
    return F.coalesce(F.filter(names, lambda n: n != ""), F.array().cast("array<string>"))


def discipline_keys(taxonomy: Column) -> Column:
    return F.transform(disciplines(taxonomy), normalize_discipline)


def has_taxonomy(taxonomy: Column) -> Column:
    doc = F.from_json(taxonomy, "struct<disciplinas:array<string>>")
    return F.coalesce(F.size(doc["disciplinas"]) > 0, F.lit(False))


def _node(path, depth, disc, item_id, text, full, parent) -> Column:
    return F.struct(path.alias("node_path"), F.lit(depth).alias("depth"), disc.alias("disciplina"), item_id.alias("item_id"),
                    text.alias("texto"), full.alias("full_path"), parent.alias("parent_path"))


def _empty() -> Column:
    return F.array().cast(f"array<{_NODE}>")


def _items(items: Column, at: Column, depth: int, disc: Column, levels: int) -> Column:
    """Nodes of one item list and everything below it. ``at`` holds the path and full name of the parent, bound once
    per node so that the expression grows with the depth only."""

    def one(item: Column, i: Column) -> Column:
        text = F.coalesce(not_blank(item["texto"]), item["id"], F.lit(""))
        item_id = F.coalesce(not_blank(item["id"]), F.concat(F.lit("item-"), i.cast("string")))
        here = F.struct(F.concat(at["path"], F.array(i)).alias("path"), text.alias("text"), item_id.alias("id"),
                        F.when(at["full"] == "", text).otherwise(F.concat(at["full"], F.lit(" > "), text)).alias("full"))

        def expand(me: Column) -> Column:
            own = F.array(_node(me["path"], depth, disc, me["id"], me["text"], me["full"], at["full"]))
            if levels > 1:
                return F.concat(own, _items(item["filhos"], me, depth + 1, disc, levels - 1))
            return own

        return let(here, expand)

    return F.coalesce(F.flatten(F.transform(items, one)), _empty())


def _legacy(subjects: Column, path: Column, disc: Column) -> Column:
    sep = F.lit(" > ")

    def level(kind, names_of, children_of, depth, build_below):
        def one(x, i, here_path, parent):
            name = F.coalesce(names_of(x), F.lit(""))
            here, full = F.concat(here_path, F.array(i)), F.concat(parent, sep, name)
            own = F.array(_node(here, depth, disc, F.concat(F.lit(kind + "-"), i.cast("string")), name, full, parent))
            return F.concat(own, build_below(children_of(x), here, full)) if build_below else own
        return one

    sub_name = lambda s: F.when(s.startswith("{"), F.get_json_object(s, "$.nome")).otherwise(s)
    spread = lambda arr, one, p, parent: F.coalesce(
        F.flatten(F.transform(arr, lambda x, i: one(x, i, p, parent))), _empty())
    sub = level("subtopico", sub_name, None, 3, None)
    topic = level("topico", lambda t: t["nome"], lambda t: t["subtopicos"], 2, lambda a, p, f: spread(a, sub, p, f))
    subject = level("assunto", lambda a: a["nome"], lambda a: a["topicos"], 1, lambda a, p, f: spread(a, topic, p, f))
    return spread(subjects, subject, path, disc)


def nesting(taxonomy: Column) -> Column:
    """The most brackets and braces that are open at once in a JSON text, those within its strings left out."""
    bare = F.regexp_replace(F.coalesce(taxonomy, F.lit("")), r'"(?:[^"\\]|\\.)*+"', "")
    signs = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, sign: Column) -> Column:
        now = acc["now"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(signs, start, step)["most"]


def nesting_bound(taxonomy: Column) -> Column:
    """At least `nesting`, by counting alone: every opening sign, but for a closed `[]`, of which one can be open at a time, and for
    a brace that opens where another has closed."""
    text = F.coalesce(taxonomy, F.lit(""))
    count = lambda part: (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)
    return count("[") + count("{") - count("[]") - count("},{") + 1


def is_deep(taxonomy: Column, max_depth: int = MAX_DEPTH) -> Column:
    """Has the document more item levels than `max_depth`, or brackets that say so? Three open ones surround the first items, and
    each level has two more."""
    limit = 4 + 2 * max_depth
    return (nesting_bound(taxonomy) > limit) & (nesting(taxonomy) > limit)


def _text(value: object) -> str | None:
    """A JSON value as a typed reader gives it for a text field."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def walked(document: str) -> Iterator[tuple]:
    """(shape, node) of every node of one document, in document order, at any depth; nothing for one that can't be read."""
    try:
        doc, _ = json.JSONDecoder(parse_int=str, parse_float=str).raw_decode(document.lstrip())  # what follows is ignored, as by Spark's readers
    except (ValueError, RecursionError):
        return
    rows = lambda x: [i if isinstance(i, dict) else {} for i in x] if isinstance(x, list) else []
    for d, discipline in enumerate(rows(doc.get("disciplinas")) if isinstance(doc, dict) else []):
        name = _text(discipline.get("nome"))
        name = "Sem nome" if name is None else name
        items = rows(discipline.get("itens"))
        shape = "nested" if items else "legacy"
        yield shape, ([d], 0, name, f"disciplina-{d}", name, name, None)
        if items:
            todo = [(item, [d, i], name) for i, item in reversed(list(enumerate(items)))]
            while todo:
                item, path, above = todo.pop()
                own_id = _text(item.get("id"))
                text = _text(item.get("texto")) or (own_id if own_id is not None else "")
                full = text if above == "" else f"{above} > {text}"
                yield shape, (path, len(path) - 1, name, own_id or f"item-{path[-1]}", text, full, above)
                todo += [(kid, [*path, i], full) for i, kid in reversed(list(enumerate(rows(item.get("filhos")))))]
            continue
        for a, subject in enumerate(rows(discipline.get("assuntos"))):
            one = f"{name} > {_text(subject.get('nome')) or ''}"
            yield shape, ([d, a], 1, name, f"assunto-{a}", _text(subject.get("nome")) or "", one, name)
            for t, topic in enumerate(rows(subject.get("topicos"))):
                two = f"{one} > {_text(topic.get('nome')) or ''}"
                yield shape, ([d, a, t], 2, name, f"topico-{t}", _text(topic.get("nome")) or "", two, one)
                for s, sub in enumerate(topic.get("subtopicos") or []):
                    label = _text(sub.get("nome") if isinstance(sub, dict) else sub) or ""
                    yield shape, ([d, a, t, s], 3, name, f"subtopico-{s}", label, f"{two} > {label}", two)


def unreadable(syllabi: DataFrame, col: str = "taxonomia") -> DataFrame:
    """Quarantine: rows whose document is neither missing nor blank and can't be read."""
    given = F.col(col).isNotNull() & (F.trim(col) != "")
    return syllabi.filter(given & F.try_parse_json(F.col(col)).isNull())


def flatten_taxonomy(syllabi: DataFrame, key: str = "edital_id", col: str = "taxonomia", max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per syllabus node, for both document shapes and any depth. A narrow transformation: no shuffle.

    Documents of up to `max_depth` item levels are read by one typed expression. Those with more are walked one by one, each within
    its own row. A document that can't be read gives no rows; `unreadable` lists them.
    """

    def one(d: Column, i: Column) -> Column:
        name = F.coalesce(d["nome"], F.lit("Sem nome"))
        path = F.array(i)
        own = F.array(_node(path, 0, name, F.concat(F.lit("disciplina-"), i.cast("string")), name, name,
                            F.lit(None).cast("string")))
        nested = F.coalesce(F.size(d["itens"]) > 0, F.lit(False))
        nodes = F.concat(own, F.when(nested, _items(d["itens"], F.struct(path.alias("path"), name.alias("full")), 1, name, max_depth)).otherwise(
            _legacy(d["assuntos"], path, name)))
        return F.struct(F.when(nested, "nested").otherwise("legacy").alias("shape"), nodes.alias("_nodes"))

    deep = F.coalesce(is_deep(F.col(col), max_depth), F.lit(False))
    doc = parsed(F.col(col), max_depth)
    per_discipline = syllabi.filter(~deep).select(key, F.inline(F.transform(doc["disciplinas"], one)))
    typed = per_discipline.select(key, "shape", F.inline("_nodes"))
    names = ["node_path", "depth", "disciplina", "item_id", "texto", "full_path", "parent_path"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, document in zip(batch[key], batch[col], strict=True):
                found = [(k, shape, *node) for shape, node in walked(document)]
                if found:
                    yield pd.DataFrame(found, columns=[key, "shape", *names])

    return typed.unionByName(syllabi.filter(deep).select(key, col).mapInPandas(walk, typed.schema))


def taxonomy_totals(nodes: DataFrame, key: str = "edital_id") -> DataFrame:
    """Disciplines, subjects, topics and all items below the disciplines, per syllabus."""
    d = F.col("depth")
    return nodes.groupBy(key).agg(F.count_if(d == 0).alias("disciplinas"), F.count_if(d == 1).alias("assuntos"),
                                  F.count_if(d == 2).alias("topicos"), F.count_if(d > 0).alias("itens"))


def coverage_counts(nodes: DataFrame, counts: DataFrame, key: str = "edital_id") -> DataFrame:
    """Nodes with the count of their exact (discipline, text) pair; zero kept."""
    c = counts.select("disciplina", F.col("assunto").alias("texto"), "n")
    return nodes.select(key, "node_path", "disciplina", "texto").join(c, ["disciplina", "texto"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))


def incidence_tree(nodes: DataFrame, links: DataFrame, disc_counts: DataFrame, topic_counts: DataFrame,
                   key: str = "edital_id", project: str = "projeto_id", scoped: bool = False) -> DataFrame:
    """Every syllabus node of every linked project with its own question count (parents are not sums).

    ``disc_counts``: (projeto_id, disciplina, n); ``topic_counts``: (projeto_id, disciplina, assunto, n), both
    already aggregated. With ``scoped`` the older topic and subtopic levels are looked up too; by default they are
    zero. All look-ups are equi-joins on (project, name).
    """
    n = links.join(nodes, key).withColumn("_scope", F.when(F.col("depth") == 0, F.lit("d")).otherwise(
        F.concat(F.lit("t:"), normalize_name(F.col("disciplina")))))
    top = disc_counts.select(project, F.lit("d").alias("_scope"), F.col("disciplina").alias("key"), "n")
    topics = topic_counts.select(project, F.concat(F.lit("t:"), normalize_name(F.col("disciplina"))).alias("_scope"),
                                 F.col("assunto").alias("key"), "n")
    found = lookup_counts(n, top.unionByName(topics), "texto", [project, "_scope"], raw=F.col("_scope") == "d")
    if not scoped:
        looked_up = (F.col("shape") == "nested") | (F.col("depth") <= 1)
        found = found.withColumn("count", F.when(looked_up, F.col("count")).otherwise(F.lit(0).cast("long")))
    return found.drop("_scope")


def nest_tree(rows: DataFrame, key: list[str], max_depth: int | None = None) -> DataFrame:
    """Rows (node_path, depth, item_id, texto, count) back to one JSON tree per key, built from the leaves up.

    All levels that the rows have, unless ``max_depth`` asks for the upper ones.

    Children are collected per parent node, which a syllabus document bounds.
    """
    fields = ["item_id", "texto", "count"]
    rows = cut_lineage(rows.select(*key, "node_path", "depth", *fields))  # read once per level
    if max_depth is None:
        max_depth = rows.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(max_depth, -1, -1):
        level = rows.filter(F.col("depth") == depth).select(
            *key, "node_path", F.slice("node_path", 1, F.size("node_path") - 1).alias("_parent"), *fields)
        if below is not None:
            level = level.join(below, [*key, "node_path"], "left")
            kids = F.coalesce("_kids", F.lit("[]"))
        else:
            kids = F.lit("[]")
        head = F.to_json(F.struct(F.col("item_id").alias("id"), F.col("texto").alias("nome"), F.col("count")))
        node = F.concat(F.expr("left(%s, length(%s) - 1)" % ("_h", "_h")), F.lit(',"children":'), kids, F.lit("}"))
        level = level.withColumn("_h", head).withColumn("_json", node)
        below = level.groupBy(*key, F.col("_parent").alias("node_path")).agg(F.concat(F.lit("["), F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("node_path", "_json"))), lambda s: s["_json"]), ","), F.lit("]")).alias("_kids"))
    return below.select(*key, F.col("_kids").alias("arvore"))


def format_taxonomy_text(syllabi: DataFrame, key: str = "edital_id", col: str = "taxonomia") -> DataFrame:
    """Indented text of the disciplines and their first two levels, built per document row."""
    doc = parsed(F.col(col), 3)

    def sub_line(name):
        return F.concat(F.lit("    └─ "), F.coalesce(name, F.lit("")))

    def item_lines(i):
        return F.concat(F.array(F.concat(F.lit("  ├─ "), F.coalesce(i["texto"], F.lit("")))),
                        F.coalesce(F.transform(i["filhos"], lambda c: sub_line(c["texto"])), F.array().cast("array<string>")))

    def subject_lines(a):
        return F.concat(F.array(F.concat(F.lit("  ├─ "), F.coalesce(a["nome"], F.lit("")))),
                        F.coalesce(F.transform(a["topicos"], lambda t: sub_line(t["nome"])), F.array().cast("array<string>")))

    def disc_lines(d):
        legacy = F.coalesce(F.size(d["assuntos"]) > 0, F.lit(False))
        lines = F.when(legacy, F.flatten(F.transform(d["assuntos"], subject_lines))).otherwise(
            F.flatten(F.transform(d["itens"], item_lines)))
        return F.concat(F.array(F.concat(F.lit("• "), d["nome"])), F.coalesce(lines, F.array().cast("array<string>")))

    return syllabi.select(key, F.coalesce(F.array_join(F.flatten(F.transform(doc["disciplinas"], disc_lines)), "\n"),
                                          F.lit("")).alias("texto"))


def coverage_share(nodes: DataFrame, covered: DataFrame, key: str = "edital_id") -> DataFrame:
    """Every node with its number of leaves (itself, if it has no children), how many of them are covered, and the share.

    ``covered``: distinct (disciplina, texto) that have questions. Each leaf counts for all prefixes of its path, so depth costs
    nothing but rows: a leaf at depth d makes d + 1 of them, which are summed before they meet. Nodes come out of a few long texts,
    so the size Spark expects of them says little: merge joins keep them off the driver.
    """
    own = nodes.select(key, "node_path", "depth", "disciplina", "texto")
    parents = own.filter("depth > 0").select(key, F.slice("node_path", 1, F.size("node_path") - 1).alias("node_path")).distinct()
    leaves = own.join(parents.hint("merge"), [key, "node_path"], "left_anti")
    hit = leaves.join(covered.select("disciplina", "texto", F.lit(1).alias("_hit")), ["disciplina", "texto"], "left")
    above = F.transform(F.sequence(F.lit(1), F.size("node_path")), lambda k: F.slice("node_path", F.lit(1), k))
    sums = hit.select(key, F.explode(above).alias("node_path"), F.coalesce("_hit", F.lit(0)).alias("_hit")).groupBy(key, "node_path").agg(
        F.count("*").alias("folhas"), F.sum("_hit").alias("cobertas"))
    return own.select(key, "node_path", "depth", "texto").join(sums.hint("merge"), [key, "node_path"]).withColumn("parcela", F.col("cobertas") / F.col("folhas"))
