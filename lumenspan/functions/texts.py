"""Message templates and SQL texts without their values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_START = r"(?<![A-Za-z0-9_])"
_END = r"(?![A-Za-z0-9_])"
_END_OF_WORD = r"(?![A-Za-z0-9])"


def template(body: Column) -> Column:
    """The message with its values replaced: quoted strings, UUIDs, hex ids, numbers (a unit after a number stays).

    Values start at a word boundary; digits inside words stay, and so do an apostrophe and an open quote.
    """
    quoted = _START + r"""(?:(")(?:[^"\\\n]|\\.)*"|(')(?:[^'\\\n]|\\.)*')"""
    for pattern, to in (
        (quoted, "$1$2<str>$1$2"),  # in one pass: the quote that opens first hides the other one
        (_START + r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}" + _END, "<uuid>"),
        (_START + r"0x[0-9a-fA-F]+" + _END_OF_WORD, "<hex>"),
        (_START + r"(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{8,}" + _END_OF_WORD, "<hex>"),
        (_START + r"[0-9]+(?:\.[0-9]+)?", "<num>"),
    ):
        body = F.regexp_replace(body, pattern, to)
    return body


def search_words(template_text: Column) -> Column:
    """The words of a template that can be searched for: those without a placeholder."""
    return F.array_join(F.filter(F.split(template_text, " "), lambda w: ~w.contains("<") & (w != "")), " ")


# The names of SQL databases in the semantic conventions, and those that they replaced.
SQL_SYSTEMS = (
    "actian.ingres aws.redshift clickhouse cockroachdb derby firebirdsql gcp.spanner h2database hive hsqldb ibm.db2 ibm.informix ibm.netezza instantdb intersystems.cache mariadb"
    " microsoft.sql_server mysql oracle.db other_sql postgresql sap.hana sap.maxdb sqlite teradata trino cache cloudscape db2 edb firebird firstsql h2 hanadb informix ingres interbase"
    " intersystems_cache maxdb mssql mssqlcompact netezza oracle pervasive pointbase progress redshift spanner sybase vertica"
).split()

# What hides text from the search for literals: identifiers in quotes (an open quote hides the rest), comments, bound
# parameters, words of any script. An x before a quote starts a literal only where a word could start.
_HIDDEN = r'"[^"]*(?:"|\z)|`[^`]*(?:`|\z)|--[^\n]*|[?$:@.][\p{L}\p{N}_]+|(?![xX]\')[\p{L}_][\p{L}\p{N}_]*'
_VALUE = r"[xX]?'(?:[^']|'')*'|0[xX][0-9a-fA-F]+|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def is_sql_system(system: Column) -> Column:
    """Whether a db.system.name (or the older db.system) is that of an SQL database."""
    return system.isin(*SQL_SYSTEMS)


def sanitize_sql(text: Column) -> Column:
    """The SQL text with ? for its literals, lists of ? and repeated groups made one; null if it has no literal."""
    # Each match is put between two marks; what was a literal leaves nothing between them.
    marked = F.regexp_replace(F.translate(text, "\u0001\u0002", ""), rf"(?s)({_HIDDEN})|{_VALUE}", "\u0001$1\u0002")
    plain = F.translate(F.replace(marked, F.lit("\u0001\u0002"), F.lit("?")), "\u0001\u0002", "")
    lists = F.regexp_replace(plain, r"\?(?:\s*,\s*\?)+", "?")
    groups = F.regexp_replace(lists, r"(\(\?\))(?:\s*,\s*\(\?\))+", "$1")
    return F.when(F.contains(marked, F.lit("\u0001\u0002")), groups)


def route_shape(path: Column) -> Column:
    """A route with every parameter part ({x}, :x, <x>, *) as {}."""
    return F.regexp_replace(path, r"\{[^/{}]*\}|(?<=/):[^/]+|<[^/<>]*>|\*", "{}")
