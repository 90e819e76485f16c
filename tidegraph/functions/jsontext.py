"""JSON documents as parsed values and canonical text, and what is read out of them.

A document is parsed once, into a variant; members are taken from that.  Text is
canonical (keys sorted, spacing removed), so equal documents are equal strings.
Numbers are compared as written: `1.0` and `1` become the same text, `1e2` and
`100` do not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIERS = "array<struct<type:string,id:string>>"


def parsed(text: Column) -> Column:
    """The document as a variant; NULL if the text is no JSON."""
    return F.try_parse_json(text)


def canonical(doc: Column) -> Column:
    return F.to_json(doc)


def member_doc(doc: Column, name: str) -> Column:
    """A top-level member as a variant; NULL when absent."""
    return F.try_variant_get(doc, f"$.{name}", "variant")


def member(doc: Column, name: str) -> Column:
    """A top-level member as canonical text; NULL when absent, `null` when JSON null."""
    return F.to_json(member_doc(doc, name))


def string_member(doc: Column, path: str) -> Column:
    """The value at `path` (members joined by dots) as a string."""
    return F.try_variant_get(doc, f"$.{path}", "string")


def identifier(type_: Column, id_: Column) -> Column:
    return F.struct(type_.alias("type"), id_.alias("id"))


def relationship_ids(relationships: Column) -> Column:
    """`identifiers` of relationships given as JSON text.

    Where the document is parsed already, give `identifiers` that: text is parsed twice here, as both kinds of `data` are read.
    """
    return identifiers(parsed(relationships))


def identifiers(doc: Column, path: str = "$") -> Column:
    """Distinct identifiers of all relationships at `path` of a parsed document, sorted by type and id.

    Each relationship holds one identifier or a list under `data`, or no `data`.
    Members that are of another kind hold no identifiers and hide no others; types and ids are strings only.
    Lists and single identifiers are taken by one cast each, in which a value of another kind becomes NULL by itself.
    """
    # Of all scalars only strings can be cast to binary: 1 and true are no ids, although they have a text.
    one = "struct<type:binary,id:binary>"

    def data(kind: str) -> Column:
        return F.map_values(F.try_variant_get(doc, path, f"map<string,struct<data:{kind}>>"))["data"]

    listed = F.flatten(F.filter(data(f"array<{one}>"), lambda ids: ids.isNotNull()))
    whole = F.filter(F.concat(listed, data(one)), lambda r: r["type"].isNotNull() & r["id"].isNotNull())
    return F.coalesce(F.sort_array(F.array_distinct(whole.cast(IDENTIFIERS))), F.array().cast(IDENTIFIERS))


def digest(*parts: Column) -> Column:
    """A fixed-size stand-in for comparing bodies of any length; NULL and the string `null` differ."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)
