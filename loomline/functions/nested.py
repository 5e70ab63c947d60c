"""Sections of blocks as nested arrays: caps, counts, filters and text without exploding them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capped(items: Column, most: int) -> Column:
    return F.slice(items, 1, most)


def capped_texts(items: Column, most: int, chars: int) -> Column:
    """At most ``most`` texts of at most ``chars`` characters."""
    return F.transform(F.slice(items, 1, most), lambda t: F.left(t, F.lit(chars)))


def blocks_of(sections: Column) -> Column:
    """All blocks of all sections."""
    return F.flatten(F.transform(sections, lambda s: F.coalesce(s["blocks"], F.array())))


def count_blocks(sections: Column, *types: str) -> Column:
    return F.aggregate(sections, F.lit(0), lambda n, s: n + F.greatest(F.size(F.filter(s["blocks"], lambda b: b["type"].isin(*types))), F.lit(0)))


def keep_blocks(sections: Column, keep) -> Column:
    """Sections with the blocks for which ``keep(section, block)`` holds."""
    return F.transform(sections, lambda s: s.withField("blocks", F.filter(s["blocks"], lambda b: F.coalesce(keep(s, b), F.lit(False)))))


def section_text(sections: Column) -> Column:
    """Headings and block texts, a line each."""
    lines = F.transform(sections, lambda s: F.concat(F.array(s["heading"]), F.transform(F.coalesce(s["blocks"], F.array()), lambda b: b["text"])))
    return F.array_join(F.filter(F.flatten(lines), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")


def coverage(sections: Column, headings: Column) -> Column:
    """Share of the asked headings that are there; one if none is asked."""
    have = F.transform(sections, lambda s: F.lower(F.trim(s["heading"])))
    hit = F.size(F.filter(headings, lambda h: F.array_contains(have, F.lower(F.trim(h)))))
    return F.when(F.size(headings) > 0, hit / F.size(headings)).otherwise(F.lit(1.0))


def thin_section(sections: Column, least: int) -> Column:
    """Whether a section has fewer than ``least`` paragraphs; each table or image stands for one."""
    weight = lambda s: F.size(F.filter(s["blocks"], lambda b: b["type"].isin("paragraph", "table", "rich_table", "image")))
    return F.exists(sections, lambda s: weight(s) < least)
