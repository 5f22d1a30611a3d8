"""Statement structure catalogue.

The structure of each distinct statement is computed by Catalyst
higher-order functions, without a Python tokenizer:

1. ``regexp_extract_all`` splits the text into tokens that keep their leading
   blanks (so joining tokens gives the text back);
2. one ``aggregate`` pass walks the tokens with a small state
   ``(depth, clause, current item, pending join keyword, BETWEEN flag, type,
   items)``: at depth 0 it switches clause on SELECT/FROM/WHERE/…, cuts the
   select list at commas, the WHERE clause at AND/OR (the AND of
   ``BETWEEN ? AND ?`` is not a cut), and the FROM clause at commas, join
   keywords and ON;
3. the emitted items are reshaped into ``type, tables, from_tokens, where,
   columns, functions``.

Items appended per token go through one ``concat(items, filter(array(...)))``
so the expression stays linear in size.

Deliberate differences from the reference (documented in README): the last
WHERE condition is kept; every condition is normalised (numbers → ?, blanks
squeezed); function calls inside a select list are kept; comma-separated
FROM items are tables; ``tables`` holds the alias when there is one, as the
reference's ``get_name()`` does, and ``table_refs`` keeps table and alias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import parallelism

# Fixed keyword sets of the clause walker.
DML_WORDS = ["SELECT", "INSERT", "UPDATE", "DELETE"]
CLAUSE_WORDS = ["FROM", "WHERE", "SET", "VALUES", "INTO"]
TAIL_WORDS = ["GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "EXCEPT", "INTERSECT", "OFFSET", "FETCH",
              "RETURNING", "FOR"]
JOIN_WORDS = ["JOIN", "INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "NATURAL"]
ON_WORDS = ["ON", "USING"]
BOOL_WORDS = ["AND", "OR"]

TOKEN_PATTERN = r"(?U)\s*(?:[(),?]|\w+(?:\.\w+)*|[^\s\w(),?]+)"
ITEM_TYPE = "struct<clause:string,text:string,sep:string>"
FUNCTION_PATTERN = r"(?U)^(\w+)\s*\((.*)\)$"
# a table item: subquery, quoted or plain name (qualified or not), then an alias
_NAME = r"(?:\"[^\"]*\"|`[^`]*`|\[[^\]]*\]|[^\s\"`\[(]+)+"
TABLE_REF_PATTERN = r"(?Uis)^(\(.*\)|" + _NAME + r")(?:\s+(?:AS\s+)?(\"[^\"]*\"|`[^`]*`|\w+))?$"
INTO_PATTERN = r"(?Uis)^(" + _NAME + ")"
DISTINCT_PATTERN = r"(?Ui)^(DISTINCT|ALL)\b\s*"


def _item(cond: Column, clause, text, sep) -> Column:
    c = clause if isinstance(clause, Column) else F.lit(clause)
    s = sep if isinstance(sep, Column) else F.lit(sep)
    return F.when(cond, F.struct(c.alias("clause"), text.alias("text"), s.alias("sep")))


def _append(items: Column, *candidates: Column) -> Column:
    return F.concat(items, F.filter(F.array(*candidates), lambda x: x.isNotNull()))


def _zero() -> Column:
    return F.struct(
        F.lit(0).alias("d"), F.lit("").alias("clause"), F.lit("").alias("cur"), F.lit("").alias("kw"),
        F.lit(False).alias("btw"), F.lit("").alias("kind"),
        F.array().cast(f"array<{ITEM_TYPE}>").alias("items"))


def _step(acc: Column, tok: Column) -> Column:
    t, u = tok["t"], tok["u"]
    d, clause, cur, kw = acc["d"], acc["clause"], acc["cur"], acc["kw"]
    top = d == 0
    in_from = clause.isin("FROM", "ON")
    is_dml = top & u.isin(*DML_WORDS)
    is_clause = top & (u.isin(*CLAUSE_WORDS) | u.isin(*TAIL_WORDS))
    boundary = is_dml | is_clause
    new_clause = F.when(is_dml, u).when(u.isin(*TAIL_WORDS), F.lit("TAIL")).otherwise(u)
    between_and = acc["btw"] & top & (u == "AND")
    sep_list = top & (((clause == "SELECT") | (clause == "SET") | (clause == "FROM")) & (u == ","))
    sep_bool = top & (clause == "WHERE") & u.isin(*BOOL_WORDS) & ~between_and
    join_word = top & in_from & u.isin(*JOIN_WORDS)
    on_word = top & (clause == "FROM") & u.isin(*ON_WORDS)
    cut = boundary | sep_list | sep_bool | join_word | on_word
    has_cur = F.trim(cur) != ""
    flush_kw = (kw != "") & ~join_word
    emit_cur = cut & has_cur
    emit_kw = flush_kw & (cut | in_from)
    items = F.when(emit_cur | emit_kw | on_word, _append(
        acc["items"],
        _item(emit_cur, clause, F.trim(cur), F.when(sep_list | sep_bool, u).otherwise(F.lit(""))),
        _item(emit_kw, "KW", kw, ""),
        _item(on_word, "KW", u, ""),
    )).otherwise(acc["items"])
    return F.struct(
        (d + F.when(u.isin("(", "CASE"), 1).when(u == ")", -1).when((u == "END") & (d > 0), -1).otherwise(0)).alias("d"),
        F.when(boundary, new_clause).when(on_word, F.lit("ON")).when(join_word, F.lit("FROM"))
        .otherwise(clause).alias("clause"),
        F.when(cut, F.lit("")).otherwise(F.concat(cur, t)).alias("cur"),
        F.when(join_word, F.trim(F.concat_ws(" ", kw, u))).when(flush_kw & (cut | in_from), F.lit(""))
        .otherwise(kw).alias("kw"),
        F.when(top & (clause == "WHERE") & (u == "BETWEEN"), F.lit(True)).when(between_and, F.lit(False))
        .otherwise(acc["btw"]).alias("btw"),
        F.when((acc["kind"] == "") & is_dml, u).otherwise(acc["kind"]).alias("kind"),
        items.alias("items"),
    )


def _finish(acc: Column) -> Column:
    items = _append(acc["items"],
                    _item(acc["kw"] != "", "KW", acc["kw"], ""),
                    _item(F.trim(acc["cur"]) != "", acc["clause"], F.trim(acc["cur"]), ""))
    return F.struct(acc["kind"].alias("kind"), items.alias("items"))


def clause_items(statement) -> Column:
    """``struct(kind, items ARRAY<struct(clause, text, sep)>)`` of a statement."""
    tokens = F.regexp_extract_all(T.col_of(statement), F.lit(TOKEN_PATTERN), 0)
    tagged = F.transform(tokens, lambda t: F.struct(t.alias("t"), F.upper(F.trim(t)).alias("u")))
    return F.aggregate(tagged, _zero(), _step, _finish)


def _texts(items: Column, clause: str) -> Column:
    return F.transform(F.filter(items, lambda x: x["clause"] == clause), lambda x: x["text"])


def _bare(name: Column) -> Column:
    """The last part of a possibly qualified name, without its quotes."""
    last = F.regexp_extract(name, r"(?s)(\"[^\"]*\"|`[^`]*`|\[[^\]]*\]|[^.]*)$", 1)
    return F.when(name.startswith("("), name).otherwise(F.regexp_replace(last, r"^[\"`\[]|[\"`\]]$", ""))


def _one_call(arguments: Column) -> Column:
    """True if the text between a call's parentheses closes none that it has not opened."""
    marks = F.split(F.regexp_replace(arguments, "[^()]", ""), "")
    state = F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda acc, m: F.struct(
        (acc["d"] + F.when(m == "(", 1).when(m == ")", -1).otherwise(0)).alias("d"),
        F.least(acc["low"], acc["d"] + F.when(m == "(", 1).when(m == ")", -1).otherwise(0)).alias("low")))
    return (state["d"] == 0) & (state["low"] == 0)


def structure_of(parsed) -> Column:
    """Q1 fields from a parsed statement (``clause_items``): ``struct(type,
    tables, table_refs, from_tokens, where, columns, functions)``.

    Table names come without qualifier and quotes, aliases without quotes; a
    leading DISTINCT or ALL belongs to no column and a bare ``*`` is none; a
    select item is a function if its first parenthesis closes at its end."""
    parsed = T.col_of(parsed)
    items = parsed["items"]
    kind = parsed["kind"]
    ref = lambda x: F.struct(
        _bare(F.regexp_extract(x, TABLE_REF_PATTERN, 1)).alias("table"),
        _bare(F.regexp_extract(x, TABLE_REF_PATTERN, 2)).alias("alias"))
    from_refs = F.transform(_texts(items, "FROM"), ref)
    update_refs = F.transform(_texts(items, "UPDATE"), ref)
    into_refs = F.transform(_texts(items, "INTO"),
                            lambda x: F.struct(_bare(F.regexp_extract(x, INTO_PATTERN, 1)).alias("table"),
                                               F.lit("").alias("alias")))
    refs = F.concat(from_refs, update_refs, into_refs)
    tables = F.transform(refs, lambda r: F.when(r["alias"] != "", r["alias"]).otherwise(r["table"]))
    from_tokens = F.transform(
        F.filter(items, lambda x: x["clause"].isin("FROM", "KW")),
        lambda x: F.struct(F.when(x["clause"] == "KW", F.lit("keyword"))
                           .when(F.trim(x["text"]).startswith("("), F.lit("subquery"))
                           .otherwise(F.lit("table")).alias("kind"),
                           x["text"].alias("value")))
    where_items = F.filter(items, lambda x: x["clause"] == "WHERE")
    where = F.when(F.size(where_items) > 0, F.transform(
        where_items, lambda x: F.struct(T.normalize_condition(x["text"]).alias("condition"),
                                        x["sep"].alias("operator"))))
    select_cols = F.transform(_texts(items, "SELECT"),
                              lambda x, i: F.when(i == 0, F.regexp_replace(x, DISTINCT_PATTERN, "")).otherwise(x))
    set_cols = F.transform(_texts(items, "SET"), lambda x: F.trim(F.substring_index(x, "=", 1)))
    into_cols = F.flatten(F.transform(
        _texts(items, "INTO"),
        lambda x: F.transform(F.split(F.regexp_extract(x, r"\((.*)\)", 1), ","), lambda c: F.trim(c))))
    columns = F.filter(F.concat(select_cols, set_cols, into_cols), lambda c: (c != "") & (c != "*"))
    functions = F.filter(
        F.transform(select_cols, lambda x: F.struct(F.regexp_extract(x, FUNCTION_PATTERN, 1).alias("function"),
                                                     F.regexp_extract(x, FUNCTION_PATTERN, 2).alias("column"))),
        lambda f: (f["function"] != "") & _one_call(f["column"]))
    return F.struct(kind.alias("type"), tables.alias("tables"), refs.alias("table_refs"),
                    from_tokens.alias("from_tokens"), where.alias("where"), columns.alias("columns"),
                    functions.alias("functions"))


def statement_structure(statement) -> Column:
    """Q1 as one column expression (convenient for small inputs; at scale use
    ``with_structure``, which walks each statement only once)."""
    return structure_of(clause_items(F.translate(T.col_of(statement), "\n", " ")))


def with_structure(df: DataFrame, col: str = "statement", kind: str | None = None) -> DataFrame:
    """Structure fields of ``col`` as columns, walking every statement once.

    The walk is projected on its own: Catalyst keeps a non-cheap expression
    that is read several times in a separate projection, so the derived fields
    read its result instead of repeating the walk.  The optional type filter
    (F13) is applied by ``inline`` of a zero-or-one element array, so it is not
    pushed below the walk and evaluated twice."""
    walked = df.select(clause_items(F.translate(F.col(col), "\n", " ")).alias("_p"))      # P17
    shaped = walked.select(structure_of("_p").alias("_s"))
    if kind is None:
        return shaped.select("_s.*")                                                      # P16
    return shaped.select(F.inline(F.filter(F.array("_s"), lambda r: r["type"] == kind)))


def walk_texts(col) -> Column:
    """``col`` with the numbers after WHERE replaced by ``?`` if it has one DML word
    only (so what follows WHERE is nothing but conditions and an unreported tail)."""
    text = T.col_of(col)
    dml = "|".join(DML_WORDS)
    where = F.regexp_extract(text, r"(?Uis)^(.*?\bWHERE\b)", 1)
    several = text.rlike(rf"(?Uis)\b(?:{dml})\b.*\b(?:{dml})\b")
    tail = F.substring(text, F.length(where) + 1, F.length(text))
    return F.when((where == "") | several, text).otherwise(F.concat(where, T.replace_numbers(tail)))


def statement_catalogue(statements: DataFrame, col: str = "line", kind: str | None = "SELECT") -> DataFrame:
    """Q8: distinct structures of the distinct statements of one type.

    Numbers of a WHERE tail are replaced first (``walk_texts``), as conditions are
    reported without them; then distinct texts (few are left), a cheap
    necessary-condition test for the type keyword, one walk per text, distinct
    structures."""
    spark = statements.sparkSession
    # The walk is CPU-bound per statement: spread the distinct texts over the
    # cluster instead of letting AQE coalesce a small shuffle into one task.
    parts = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # (by number, round robin: a repartition on the distinct's own key would
    # be dropped as redundant and the small shuffle coalesced again)
    texts = statements.select(walk_texts(col).alias("statement")).distinct().repartition(parts)
    if kind is not None:
        texts = texts.filter(F.upper("statement").contains(kind))
    return with_structure(texts, "statement", kind).distinct()


def catalogue_strings(catalogue: DataFrame) -> DataFrame:
    """CSV-friendly form of the catalogue (K2): lists joined, nested parts as JSON."""
    return catalogue.select(
        "type",
        F.array_join("tables", ",").alias("tables"),
        F.to_json("from_tokens").alias("from_tokens"),
        F.to_json("where").alias("where"),
        F.array_join("columns", ",").alias("columns"),
        F.to_json("functions").alias("columns_tokens"))
