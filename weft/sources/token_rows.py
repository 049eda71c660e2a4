"""Facts of nested source text from rows of tokens: which branches guard a call or an assignment, and how local variables get their values.

A text becomes one row a token, with its place, the depth of its brackets and blocks as running sums, and for each opening one the place of
its partner: at one depth openings and closings alternate, so the partner is the next one there. Branches are then intervals of
places, and what they guard is a join of places with intervals. There is no grammar; statements are told by the words they begin with.
Windows run over the tokens of one file, and what stands at another place is brought along by them: the texts are dealt by path before they become
tokens, so tokens never move, and only the few rows that mark branches, calls and assignments are written and joined. Null and empty texts give no rows; a bracket that is never closed has no partner and guards nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import squeezed
from weft.operators.shared import kept
from weft.sources.source_text import dealt

CS_TOKENS = r'(\s+|//[^\n]*|/\*[\s\S]*?\*/|@"(?:[^"]|"")*"|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|=>|\w+|[\s\S])'
SQL_TOKENS = r"(\s+|--[^\n]*|/\*[\s\S]*?\*/|N?'(?:[^']|'')*'|\[[^\]\n]*\]|[@#]{0,2}\w+|<>|[<>!]=|[\s\S])"

# Words that begin a statement, and words before a bracket that are no calls.
SQL_STATEMENTS = ["SET", "SELECT", "RETURN", "EXEC", "EXECUTE", "INSERT", "UPDATE", "DELETE", "DECLARE", "IF", "WHILE", "PRINT", "RAISERROR", "THROW", "BEGIN", "END", "ELSE"]
CS_KEYWORDS = ["if", "for", "foreach", "while", "switch", "using", "lock", "catch", "fixed", "return", "typeof", "nameof", "sizeof", "default", "when", "await", "new", "base", "this"]


def tokens(files: DataFrame, pattern: str) -> DataFrame:
    """(path, i, at, token) of files (path, text), dealt by path: i numbers what is no space or comment, at is the place in the text."""
    each = dealt(files).select("path", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("k", "token"))
    order = Window.partitionBy("path").orderBy("k")
    at = F.sum(F.length("token")).over(order) - F.length("token") + 1
    told = each.withColumn("at", at.cast("int")).where(~F.rlike("token", F.lit(r"^(?:\s|//|/\*|--)")))
    return told.select("path", (F.row_number().over(order) - 1).alias("i"), "at", "token")


def bracketed(rows: DataFrame, kinds: dict[str, tuple[Column, Column]]) -> DataFrame:
    """rows with, for each kind of bracket (opening, closing), its depth (inside: of the brackets themselves, too) and the partner of each opening one."""
    order = Window.partitionBy("path").orderBy("i")
    for name, (opens, closes) in kinds.items():
        change = F.when(opens, 1).when(closes, -1).otherwise(0)
        rows = rows.withColumn(f"{name}_kind", change).withColumn(name, F.sum(f"{name}_kind").over(order) + F.when(closes, 1).otherwise(0))
        rows = rows.withColumn(f"{name}_is", F.col(f"{name}_kind") != 0)
        rows = rows.withColumn(f"{name}_end", F.when(F.col(f"{name}_kind") == 1, F.lead("i").over(partners(name))))
    return rows


def partners(name: str):
    """The brackets of a kind at one depth, where openings and closings alternate."""
    return Window.partitionBy("path", f"{name}_is", name).orderBy("i")


def following(rows: DataFrame, words: dict[str, int]) -> DataFrame:
    """rows with the tokens around them: name -> how many places on."""
    order = Window.partitionBy("path").orderBy("i")
    return rows.withColumns({name: (F.lead("token", n) if n > 0 else F.lag("token", -n)).over(order) for name, n in words.items()})


def next_hit(hit: Column, what: str | Column, by: tuple[str, ...]) -> Column:
    """what of the next row after each, of the same by, that is a hit: a running value from the end."""
    after = Window.partitionBy("path", *by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(hit, F.col(what) if isinstance(what, str) else what), ignorenulls=True).over(after)


def by_path(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides: the files of these tables are far smaller than their rows, so their size must not let a side be broadcast."""
    return df.hint("merge")


def cs_marks(files: DataFrame) -> DataFrame:
    """The rows of opening brackets and of else: (path, i, at, token, before, before2, next, close, to, c_next, c_end, n_end).

    close and to are the places of a bracket's partner, c_next and c_end the token after it and the end of the body that begins there; n_end is the end of the
    body after an else. A body is a block, or goes up to the next semicolon.
    """
    t = F.col("token")
    rows = bracketed(tokens(files, CS_TOKENS), {"brace": (t == "{", t == "}"), "paren": (t == "(", t == ")")})
    rows = rows.withColumn("body_end", F.when(t == "{", F.col("brace_end")).otherwise(next_hit(t == ";", "i", ("brace", "paren"))))
    rows = following(rows, {"next": 1, "before": -1, "before2": -2}).withColumn("n_end", F.lead("body_end").over(Window.partitionBy("path").orderBy("i")))
    partner = F.when(t == "(", F.lead(F.struct("i", "at", "next", "n_end")).over(partners("paren")))
    rows = rows.withColumn("p", partner).where("token in ('(', 'else')")
    return rows.select("path", "i", "at", "token", "before", "before2", "next", F.col("p.i").alias("close"), F.col("p.at").alias("to"), F.col("p.next").alias("c_next"), F.col("p.n_end").alias("c_end"), "n_end")


def cs_methods(marks: DataFrame) -> DataFrame:
    """(path, method, start, end): bodies in braces or behind an arrow; a name, its brackets, then the body."""
    named = marks.where((F.col("token") == "(") & F.rlike("before", F.lit(r"^[A-Za-z_]\w*$")) & ~F.col("before").isin(CS_KEYWORDS) & F.col("c_next").isin("{", "=>"))
    return named.where("c_end is not null").select("path", F.col("before").alias("method"), (F.col("close") + 1).alias("start"), F.col("c_end").alias("end"))


def cs_branches(marks: DataFrame, files: DataFrame) -> DataFrame:
    """(path, condition, has_else, branch, start, end, if_at): the then and else parts of each if, blocks or single statements; an else that goes on with an if is that if's."""
    own = marks.where("token = '(' and before = 'if' and c_next is not null").select("path", (F.col("i") - 1).alias("if_at"), F.col("at").alias("from"), "to", (F.col("close") + 1).alias("start"), F.col("c_end").alias("end"))
    heads = own.join(by_path(files.select("path", "text")), "path").withColumn("condition", squeezed(F.expr("substring(text, from + 1, to - from - 1)"))).drop("text", "from", "to")
    other = marks.where("token = 'else'").select("path", (F.col("i") - 1).alias("end"), F.col("i").alias("else_at"), F.col("next").alias("else_token"), F.col("n_end").alias("e_end"))
    joined = heads.join(by_path(other), ["path", "end"], "left")
    parts = [("then", F.col("start"), F.col("end"), F.lit(True)), ("else", F.col("else_at") + 1, F.col("e_end"), F.col("else_token") != "if")]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("branch"), start.alias("start"), end.alias("end"), is_one.alias("is_one")) for name, start, end, is_one in parts])).alias("b")
    both = joined.select("path", "condition", F.col("else_at").isNotNull().alias("has_else"), "if_at", each)
    return both.where("b.is_one and b.end is not null").select("path", "condition", "has_else", "b.branch", "b.start", "b.end", "if_at")


def cs_calls(marks: DataFrame) -> DataFrame:
    """(path, i, callee): a name before an opening bracket that is no keyword and no declaration (which its type stands before)."""
    called = marks.where((F.col("token") == "(") & F.rlike("before", F.lit(r"^[A-Za-z_]\w*$")) & ~F.col("before").isin(CS_KEYWORDS))
    ahead = F.coalesce("before2", F.lit(""))
    declared = F.rlike(ahead, F.lit(r"^(?:[A-Za-z_]\w*|>|\]|\?)$")) & ~ahead.isin("return", "await", "else", "in", "throw", "case", "new", "is", "and", "or", "not")
    return called.where(~declared).select("path", (F.col("i") - 1).alias("i"), F.col("before").alias("callee"))


def innermost(places: DataFrame, intervals: DataFrame, keep: list[str]) -> DataFrame:
    """places (path, i, ...), one row a place, with the kept columns of the interval around them that starts last; none where no interval holds them."""
    around = intervals.select("path", F.col("start").alias("w_start"), F.col("end").alias("w_end"), F.struct("start", *keep).alias("w"))
    inside = places.join(by_path(around), "path", "left").withColumn("w", F.when(F.col("i").between(F.col("w_start"), F.col("w_end")), F.col("w")))
    best = inside.groupBy(*places.columns).agg(F.max("w").alias("w"))
    return best.select(*places.columns, *[F.col(f"w.{c}").alias(c) for c in keep])


def cs_guarded_calls(files: DataFrame) -> DataFrame:
    """(path, method, callee, condition, branch): every call with the innermost if of its own method that guards it."""
    marks = kept(cs_marks(files))
    called = innermost(cs_calls(marks), cs_methods(marks).withColumn("m_start", F.col("start")), ["method", "m_start"]).where("method is not null")
    guards = innermost(called, cs_branches(marks, files).withColumn("g_start", F.col("start")), ["condition", "branch", "g_start"])
    own = F.col("g_start") > F.col("m_start")  # not an if around a local function
    return guards.select("path", "method", "callee", "i", F.when(own, F.col("condition")).alias("condition"), F.when(own, F.col("branch")).alias("branch"))


def cs_branch_reads(files: DataFrame) -> DataFrame:
    """(path, method, member, condition, has_else): the members (a.b: b) that conditions of ifs read, in the method around them."""
    marks = kept(cs_marks(files))
    ifs = cs_branches(marks, files).where("branch = 'then'").select("path", F.col("if_at").alias("i"), "condition", "has_else")
    held = innermost(ifs, cs_methods(marks), ["method"]).where("method is not null")
    names = F.regexp_extract_all(F.regexp_replace("condition", r'"(?:[^"\\]|\\.)*"', '""'), F.lit(r"\.\s*([A-Za-z_]\w*)\b(?!\s*[(.\w])"), F.lit(1))
    return held.select("path", "method", F.explode(F.array_distinct(names)).alias("member"), "condition", "has_else")


def sql_rows(files: DataFrame) -> DataFrame:
    upper = F.upper("token")
    rows = following(tokens(files, SQL_TOKENS).withColumn("word", upper), {"next": 1, "before": -1})
    tran = F.upper(F.coalesce("next", F.lit(""))).isin("TRAN", "TRANSACTION")
    opens = (F.col("word").isin("BEGIN") & ~tran) | (F.col("word") == "CASE")
    rows = bracketed(rows, {"block": (opens, F.col("word") == "END"), "paren": (F.col("token") == "(", F.col("token") == ")")})
    return rows.withColumn("level", F.col("block") - (F.col("block_kind") == 1).cast("int"))  # an opening word is a statement of the block around it, END ends its own


def in_case(rows: DataFrame) -> DataFrame:
    """rows with in_case: whether a CASE is open there, by a running sum of the CASEs and of the ENDs that close one."""
    ends_case = F.col("block_is") & (F.lag("word").over(partners("block")) == "CASE")
    both = rows.withColumn("ends_case", F.coalesce(ends_case, F.lit(False)))
    change = F.when(F.col("word") == "CASE", 1).when(F.col("ends_case"), -1).otherwise(0)
    open_ = F.sum(change).over(Window.partitionBy("path").orderBy("i")) + F.when(F.col("ends_case"), 1).otherwise(0)
    return both.withColumn("in_case", open_ > 0).drop("ends_case")


def sql_marks(files: DataFrame) -> DataFrame:
    """The rows of IF, ELSE and of the = that assign: (path, i, at, word, level, paren, last, chain, h, e_end, assigned).

    h is where an IF's condition ends: the place (i), place in the text (at) and end of the statement after it; e_end is the end of what an ELSE guards, none
    if it goes on with an IF. assigned is the variable, the kind, and the ends (from, to) of the value in the text.
    """
    order, nested = Window.partitionBy("path").orderBy("i"), ("level", "paren")
    begins, outside = F.col("word").isin(SQL_STATEMENTS), (F.col("paren") == 0) & ~F.col("in_case")
    told = F.last(F.when(begins & outside, F.struct("word", "i")), ignorenulls=True).over(order)
    text_end = F.col("at") + F.length("token")
    rows = in_case(sql_rows(files)).withColumns({"said": told, "next_at": F.lead("at").over(order), "back": F.coalesce(F.lag(text_end).over(order), F.lit(1))})
    used = F.col("word").isin(*SQL_STATEMENTS, "FROM", "WHERE") | F.col("token").isin("=", ",", ";") | F.col("token").startswith("@")
    rows = rows.where(used | (F.upper("before") == "ELSE") | F.col("next_at").isNull())  # no other row is looked up from here on
    rows = rows.withColumns({"statement": F.col("said.word"), "from_seen": F.col("said.i"), "whole": F.last(F.struct((F.col("i") + 1).alias("i"), text_end.alias("back"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    rows = rows.withColumns({"stop": next_hit(begins, "i", nested), "until": next_hit(begins | (F.col("token") == ";"), F.struct("i", "back"), nested)})
    rows = rows.withColumn("comma", next_hit((F.col("token") == ",") | F.col("word").isin("FROM", "WHERE"), F.struct("i", "back"), (*nested, "from_seen")))
    rows = rows.withColumn("last", F.col("whole.i") - 1).withColumn("part_end", F.when(F.col("word") == "BEGIN", F.col("block_end")).otherwise(F.coalesce(F.col("stop") - 1, "last")))
    rows = rows.withColumn("h", next_hit(begins, F.struct("i", "at", "part_end"), nested)).withColumn("e_end", F.lead(F.when(F.col("word") != "IF", F.col("part_end"))).over(order))
    heads = F.upper("before").isin("SET", "SELECT", "DECLARE", ",")
    v = F.last(F.when(F.col("token").startswith("@"), F.struct("i", "token", heads.alias("heads"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    value = F.struct(F.col("v.token").alias("variable"), F.lower("statement").alias("kind"), F.col("next_at").alias("from"), F.least(F.coalesce("until", "whole"), F.coalesce("comma", "whole"))["back"].alias("to"))
    gives = F.col("statement").isin("DECLARE", "SET", "SELECT") & (F.col("v.i") > F.col("from_seen")) & F.col("v.heads") & ((F.col("statement") == "DECLARE") | (F.col("v.i") == F.col("i") - 1)) & F.col("next_at").isNotNull()
    rows = rows.withColumn("v", v).withColumn("assigned", F.when((F.col("token") == "=") & outside & gives, value))
    own = rows.where("word in ('IF', 'ELSE') or assigned is not null")
    chain = F.sum(((F.col("word") == "IF") & (F.coalesce(F.upper("before"), F.lit("")) != "ELSE")).cast("int")).over(Window.partitionBy("path", *nested).orderBy("i"))
    return own.withColumn("chain", chain).select("path", "i", "at", "word", "level", "paren", "last", "chain", "h", "e_end", "assigned")


def sql_branches(marks: DataFrame, files: DataFrame) -> DataFrame:
    """(path, guard, start, end): what IF and ELSE guard, blocks or single statements; an ELSE's guard is NOT (label)."""
    own = marks.where("word = 'IF' and h is not null").select("path", "level", "paren", "chain", F.col("at").alias("from"), F.col("h.at").alias("to"), F.col("h.i").alias("start"), F.col("h.part_end").alias("end"))
    heads = own.join(by_path(files.select("path", "text")), "path").withColumn("label", squeezed(F.expr("substring(text, from + 2, to - from - 2)"))).drop("text")
    elses = marks.where("word = 'ELSE'").select("path", (F.col("i") - 1).alias("end"), (F.col("i") + 1).alias("e_start"), "e_end")
    both = heads.join(by_path(elses), ["path", "end"], "left")
    # an ELSE that goes on with an IF guards all of that chain
    whole = F.max(F.greatest("end", "e_end")).over(Window.partitionBy("path", "level", "paren", "chain"))
    both = both.withColumn("e_end", F.coalesce("e_end", whole))
    negated = F.concat(F.lit("NOT ("), "label", F.lit(")"))
    each = F.explode(F.array(F.struct(F.col("label").alias("guard"), F.col("start").alias("start"), F.col("end").alias("end")), F.struct(negated.alias("guard"), F.col("e_start").alias("start"), F.col("e_end").alias("end")))).alias("b")
    return both.select("path", each).select("path", "b.*").where("start is not null and end is not null")


def sql_assignments(files: DataFrame) -> DataFrame:
    """(path, i, variable, kind, value, guards): DECLARE, SET and SELECT that give a local variable a value, with the labels around them, outermost first."""
    marks = kept(sql_marks(files))
    each = marks.where("assigned is not null").select("path", "i", "assigned.*").join(by_path(files.select("path", "text")), "path")
    valued = each.select("path", "i", "variable", "kind", squeezed(F.expr("substring(text, from, to - from)")).alias("value"))
    around = sql_branches(marks, files).select("path", F.col("start").alias("w_start"), F.col("end").alias("w_end"), F.struct("start", "guard").alias("w"))
    inside = valued.join(by_path(around), "path", "left").withColumn("w", F.when(F.col("i").between(F.col("w_start"), F.col("w_end")), F.col("w")))
    return inside.groupBy("path", "i", "variable", "kind", "value").agg(F.transform(F.array_sort(F.collect_set("w")), lambda g: g["guard"]).alias("guards"))


def variable_notes(assignments: DataFrame) -> DataFrame:
    """(path, variable, note): a variable's values in order: the first, then each with the guards it is given under."""
    said = F.concat("value", F.when(F.size("guards") > 0, F.concat(F.lit(" WHEN "), F.array_join("guards", " AND "))).otherwise(""))
    each = assignments.groupBy("path", "variable").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", said.alias("said")))), lambda x: x["said"]), " -> ").alias("values"))
    return each.select("path", "variable", F.concat("variable", F.lit(" = "), "values").alias("note"))


def sql_arms(files: DataFrame) -> DataFrame:
    """(path, query, arm, position, item, alias): the items of the select lists outside brackets; arms of one query are joined by set operators, and items answer each other by position.

    The alias of an item is its own name where it has none (AS name, name = item, or the last part of a dotted name); the first arm's aliases name the result.
    """
    order = Window.partitionBy("path").orderBy("i")
    text_end = F.col("at") + F.length("token")
    rows = in_case(sql_rows(files)).withColumns({"from": F.lead("at").over(order), "back": F.lag(text_end).over(order), "after": F.lead("i").over(order)})
    ends = F.col("word").isin("FROM", "INTO", "WHERE", "ORDER", "UNION", "EXCEPT", "INTERSECT", *[w for w in SQL_STATEMENTS if w != "SELECT"]) | (F.col("token") == ";")
    outside = (F.col("paren") == 0) & ~F.col("in_case")
    what = F.when((F.col("paren") == 0) & (F.col("word") == "SELECT"), "select").when(outside & ends, "end").when(outside & (F.col("token") == ","), "comma")
    joined = F.upper(F.coalesce("before", F.lit(""))).isin("UNION", "ALL", "EXCEPT", "INTERSECT")
    marks = rows.withColumn("what", what).where("what is not null or after is null").withColumns({"is_head": F.coalesce(F.col("what") == "select", F.lit(False)), "joined": joined})
    # a mark belongs to the select list that is open there: the last SELECT, unless an end came since; the last token of a file ends a list, too
    told = marks.withColumns({"query": F.sum((F.col("is_head") & ~F.col("joined")).cast("int")).over(order), "heads": F.sum(F.col("is_head").cast("int")).over(order), "open": F.last(F.when(F.col("what") != "comma", F.col("what")), ignorenulls=True).over(order)})
    told = told.withColumn("arm", (F.col("heads") - F.min(F.when(F.col("is_head"), F.col("heads"))).over(Window.partitionBy("path", "query")) + 1).cast("int"))
    until = F.lead(F.when(F.col("what").isNotNull(), F.col("back")).otherwise(text_end)).over(order)
    told = told.withColumn("until", F.when(F.col("after").isNull(), text_end).otherwise(until))
    items = told.where("open = 'select' and what is not null and heads > 0 and from is not null").withColumn("position", F.row_number().over(Window.partitionBy("path", "query", "arm").orderBy("i")))
    said = items.where("until > from").join(by_path(files.select("path", "text")), "path")
    said = said.withColumn("item", F.regexp_replace(squeezed(F.expr("substring(text, from, until - from)")), r"(?i)^(?:DISTINCT |ALL |TOP ?\(?\d+\)? (?:PERCENT )?)+", ""))
    bare = lambda c: F.regexp_replace(c, r"^\[|\]$", "")
    named = F.regexp_extract("item", r"(?i)\bAS (\[[^\]]+\]|[\w']+)$", 1)
    given = F.regexp_extract("item", r"^(\[[^\]]+\]|\w+) ?= ?", 1)
    own = F.regexp_extract("item", r"^(?:\[?\w+\]?\.)*(\[[^\]]+\]|\w+)$", 1)
    spaced = F.regexp_extract("item", r"[\w)\]] (\[[^\]]+\]|[A-Za-z_]\w*)$", 1)
    alias = F.coalesce(*[F.when(c != "", bare(c)) for c in (named, given, own, F.when(~F.rlike("item", F.lit(r"(?i)\bEND$")), spaced))])
    return said.select("path", F.col("query").cast("int").alias("query"), "arm", "position", "item", alias.alias("alias"))


def sql_result_columns(arms: DataFrame) -> DataFrame:
    """(path, query, position, name, items): each column of a query, named by its first arm, with the items of all arms at its position."""
    each = arms.groupBy("path", "query", "position").agg(F.min_by("alias", "arm").alias("name"), F.transform(F.array_sort(F.collect_list(F.struct("arm", "item"))), lambda x: x["item"]).alias("items"))
    return each.select("path", "query", "position", "name", "items")
