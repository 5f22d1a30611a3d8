"""Statement structure on own statements of the shapes the log holds, and literal cases per field."""
import pytest

from qtrail.operators import structure as S

def _structure(spark, q):
    df = spark.createDataFrame([(q,)], "q string")
    return df.select(S.statement_structure("q").alias("s")).collect()[0].s


def test_type_is_the_first_statement_word(spark):
    assert [_structure(spark, q).type for q in ("select 1", "DELETE FROM T WHERE A=1", "WITH X")] == ["SELECT", "DELETE", ""]


def test_table_references_carry_their_alias(spark):
    s = _structure(spark, "SELECT P FROM DEPOT D INNER JOIN TRUCK ON D.T = TRUCK.N CROSS JOIN ROUTE AS R")
    assert [(r.table, r.alias) for r in s.table_refs] == [("DEPOT", "D"), ("TRUCK", ""), ("ROUTE", "R")]
    assert s.tables == ["D", "TRUCK", "R"]


def test_from_tokens_keep_keywords_in_place(spark):
    s = _structure(spark, "SELECT P FROM DEPOT RIGHT JOIN TRUCK USING (N), YARD")
    assert [(t.kind, t.value) for t in s.from_tokens if t.kind == "keyword"] == [("keyword", "RIGHT JOIN"), ("keyword", "USING")]
    assert [t.value for t in s.from_tokens if t.kind == "table"][0] == "DEPOT"


def test_columns_keep_their_as(spark):
    assert _structure(spark, "SELECT W AS WEIGHT, H, L AS LENGTH FROM CRATE").columns == ["W AS WEIGHT", "H", "L AS LENGTH"]


def test_functions_of_the_select_list(spark):
    s = _structure(spark, "SELECT SUM(KG), N, AVG(PRICE) FROM CRATE GROUP BY N HAVING SUM(KG) > 5")
    assert [(f.function, f.column) for f in s.functions] == [("SUM", "KG"), ("AVG", "PRICE")]


def test_conditions_and_what_joins_them(spark):
    s = _structure(spark, "SELECT N FROM CRATE WHERE KG > 10 OR (RED = 'y' OR\n OLD = 'n') OR N IS NULL ORDER BY KG")
    assert [(w.condition, w.operator) for w in s.where][0] == ("KG > ?", "OR")
    assert [w.operator for w in s.where] == ["OR", "OR", ""] and s.where[2].condition == "N IS NULL"
    assert s.where[1].condition.startswith("(RED = ") and "\n" not in s.where[1].condition


@pytest.mark.parametrize("statement, tables, columns, functions, conditions", [
    ("SELECT MAX(A)-MIN(B) FROM T", ["T"], ["MAX(A)-MIN(B)"], [], None),
    ("SELECT UPPER(A) || LOWER(B) FROM T", ["T"], ["UPPER(A) || LOWER(B)"], [], None),
    ("SELECT F(G(A),H(B)) FROM T", ["T"], ["F(G(A),H(B))"], [("F", "G(A),H(B)")], None),
    ("SELECT A FROM T as V", ["V"], ["A"], [], None),
    ('SELECT A FROM "My Table" X, `Odd.Name`', ["X", "Odd.Name"], ["A"], [], None),
    ("SELECT A FROM DB.T", ["T"], ["A"], [], None),
    ("SELECT DISTINCT A,B FROM T", ["T"], ["A", "B"], [], None),
    ("SELECT * FROM T", ["T"], [], [], None),
    ("SELECT T.*,DISTINCT_COUNT FROM T", ["T"], ["T.*", "DISTINCT_COUNT"], [], None),
    ("SELECT A FROM T WHERE CASE WHEN X=1 AND Y=2 THEN 3 END = 3 AND Z=4", ["T"], ["A"], [],
     ["CASE WHEN X=? AND Y=? THEN ? END = ?", "Z=?"]),
])
def test_fields(spark, statement, tables, columns, functions, conditions):
    s = _structure(spark, statement)
    assert (s.tables, s.columns, [tuple(f) for f in s.functions]) == (tables, columns, functions)
    assert (s.where and [w.condition for w in s.where]) == conditions


def test_numbers_are_gone_before_the_walk(spark):
    rows = [(f"SELECT A FROM T{i % 3} WHERE B = {i} AND C = {i}.5 ORDER BY {i}",) for i in range(300)]
    rows += [("SELECT A FROM (SELECT 5 X FROM U WHERE B=1) Q WHERE X=2",), ("UPDATE T SET A=1 WHERE B=2",)]
    df = spark.createDataFrame(rows, "line string")
    walked = {r[0] for r in df.select(S.walk_texts("line")).collect()}
    assert walked == {f"SELECT A FROM T{k} WHERE B = ? AND C = ? ORDER BY ?" for k in range(3)} | {
        "SELECT A FROM (SELECT 5 X FROM U WHERE B=1) Q WHERE X=2", "UPDATE T SET A=1 WHERE B=?"}
    plain = S.with_structure(df.distinct(), "line", "SELECT").distinct().collect()
    assert sorted(map(str, S.statement_catalogue(df).collect())) == sorted(map(str, plain))


def test_between_and_write_statements(spark):
    s = _structure(spark, "UPDATE ORDERS SET TOTAL = 1.5, X=2 WHERE ORDERS.ID = 77 AND A BETWEEN 1 AND 5 OR B=1")
    assert (s.type, s.tables, s.columns) == ("UPDATE", ["ORDERS"], ["TOTAL", "X"])
    assert [(w.condition, w.operator) for w in s.where] == [("ORDERS.ID = ?", "AND"), ("A BETWEEN ? AND ?", "OR"),
                                                            ("B=?", "")]
    s = _structure(spark, "INSERT INTO USERS (ID,NAME) VALUES (8,?)")
    assert (s.type, s.tables, s.columns, s.where) == ("INSERT", ["USERS"], ["ID", "NAME"], None)
    s = _structure(spark, "SELECT X FROM (SELECT Y FROM Z WHERE A=1) Q, W AS V WHERE Q.X = W.X")
    assert s.tables == ["Q", "V"] and s.from_tokens[0].kind == "subquery"


def test_catalogue_distinct_selects(spark):
    one, other = "SELECT N FROM CRATE WHERE KG = ?", "SELECT N, KG FROM CRATE C, YARD"
    rows = [(one,), (one.replace("KG = ?", "KG  =   ?"),), (other,), ("UPDATE T SET A=1",)]
    cat = S.statement_catalogue(spark.createDataFrame(rows, "line string"))
    assert cat.count() == 2
    assert S.catalogue_strings(cat).columns == ["type", "tables", "from_tokens", "where", "columns", "columns_tokens"]
