"""Main text of web pages from flat text blocks.

A page is cut at block tags into text blocks. A decision tree, trained on a
small labelled table of blocks, classifies each from its word count and link
density, those of its neighbours, and what is around it: whether it is in a
main part or beside one, in an element of page furniture, and hints of names.
Hints of furniture are outvoted by long unlinked text. Elements of furniture,
and names of adverts and of readers' comments, whose text looks like any other,
are not.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import decoded, prepare

#: HTML's block elements, void elements, elements without page
#: text, elements whose content isn't markup, elements of page furniture, and
#: elements that end another of their name.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math head title textarea object canvas audio video iframe select".split())
RAW = frozenset("script style textarea title".split())
FURNITURE = frozenset("nav footer aside form menu button dialog header".split())
MAIN = frozenset("article main".split())
SELF_ENDING = frozenset("p li option td th tr dd dt".split())
#: Words of a class, id or role that adverts and comments have (hint 3), that
#: furniture has (hint 2), and that content has too (hint 1). A hint is a
#: feature of the tree like others.
FOREIGN = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor(?:s|ed)?|comments?|repl(?:y|ies)|respond|disqus)(?=$|[\s_-])", re.I)
NAMED = re.compile(r"(?:^|[\s_-])(?:promo\w*|nav\w*|navbar|menu\w*|breadcrumb\w*|footer|masthead|sidebar\w*|cookie\w*|consent|popup|modal|newsletter|subscribe|signup|login|social\w*|recommend\w*|pagination|pager|toolbar|skip\w*)(?=$|[\s_-])", re.I)
VAGUE = re.compile(r"(?:^|[\s_-])(?:banner\w*|header|side|widget\w*|notice\w*|alert|share\w*|related|copyright|legal|search\w*|tags?|teasers?)(?=$|[\s_-])", re.I)
#: The words that count for an article or main, whose class also lists tags and layout.
ASIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|teasers?|related|recommend\w*|comment|comment-body|repl(?:y|ies)|respond|disqus)(?=$|[\s_-])", re.I)
#: An element that holds a heading or main part and half of the page's unlinked
#: words, or ``BODY_WORDS`` and nearly all of them, surrounds the page and is
#: no furniture, whatever it is or is called.
BODY_WORDS = 100
#: A short block outside of a main part that says whose the rights are has hint 2.
LEGAL, LEGAL_WORDS = re.compile(r"^\W*(?:©|\(c\)|copyright)\W+(?:\w+\W+){0,6}?(?:19|20)\d\d|\ball rights reserved\b|\balle rechte vorbehalten\b|\btous droits réservés\b|\btodos los derechos reservados\b", re.I), 40
_NAME_OF = re.compile(r"(/?)([A-Za-z][^\s/>]*+)")
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")

#: The labelled table: words, link density, words before, words after, link
#: density before, link density after, in a furniture element, hint, main (1 in
#: it, -1 beside it, 0 in a page without), heading; content.
TABLE = (
    # menus, footers, sidebars, forms, headers by their element
    (1, 1.0, 0, 1, 0, 1.0, 1, 0, 0, 0, 0), (2, 1.0, 1, 1, 1.0, 1.0, 1, 0, 0, 0, 0), (1, 1.0, 1, 8, 1.0, 0, 1, 0, 0, 0, 0), (8, 0.0, 1, 12, 1.0, 0, 1, 0, 0, 0, 0),
    (24, 0.0, 2, 12, 1.0, 0, 1, 0, 0, 0, 0), (60, 0.0, 40, 0, 0, 0, 1, 0, 0, 0, 0), (9, 0.0, 30, 0, 0, 0, 1, 0, 0, 0, 0), (35, 0.2, 80, 0, 0, 0, 1, 0, 1, 0, 0),
    (12, 0.0, 5, 7, 0, 0, 1, 0, 1, 0, 0), (120, 0.0, 90, 70, 0, 0, 1, 0, 0, 0, 0), (6, 0.0, 0, 10, 0, 0, 1, 0, 0, 1, 0), (4, 0.0, 10, 20, 0, 0, 1, 0, 1, 1, 0),
    (200, 0.0, 90, 70, 0, 0, 1, 2, 0, 0, 0), (14, 0.0, 60, 60, 0, 0, 1, 1, 1, 0, 0), (22, 0.0, 8, 16, 0, 0, 1, 1, 1, 0, 0), (90, 0.0, 60, 60, 0, 0, 1, 1, 1, 0, 0), (100, 0.0, 60, 60, 0, 0, 1, 2, 1, 0, 0), (80, 0.0, 60, 60, 0, 0, 1, 0, 1, 0, 0), (3, 0.0, 200, 60, 0, 0, 1, 1, 1, 0, 0),
    # adverts and comments by their names; vague names with scraps and links
    (8, 0.0, 1, 12, 1.0, 0, 0, 3, 0, 0, 0), (16, 0.0, 1, 4, 1.0, 0, 0, 3, 0, 0, 0), (60, 0.0, 40, 70, 0, 0, 0, 3, 0, 0, 0), (30, 0.0, 60, 60, 0, 0, 0, 3, 1, 0, 0),
    (12, 0.0, 80, 60, 0, 0, 0, 3, 1, 0, 0), (150, 0.0, 60, 80, 0, 0, 0, 3, 1, 0, 0), (4, 0.0, 60, 60, 0, 0, 0, 3, 1, 1, 0), (120, 0.0, 10, 10, 0, 0, 0, 3, 0, 0, 0),
    (6, 0.0, 60, 60, 0, 0, 0, 1, 0, 0, 0), (20, 0.0, 3, 60, 1.0, 0, 0, 1, 0, 0, 0), (16, 0.0, 60, 3, 0, 1.0, 0, 1, 0, 0, 0), (25, 0.0, 60, 4, 0, 0, 0, 1, 0, 0, 0),
    (5, 0.0, 60, 60, 0, 0, 0, 1, 1, 0, 0), (6, 0.5, 60, 60, 0, 0, 0, 1, 1, 0, 0), (3, 1.0, 60, 3, 0, 1.0, 0, 1, 1, 0, 0), (14, 0.8, 60, 9, 0, 0.9, 0, 1, 1, 0, 0), (2, 0.0, 60, 5, 0, 1.0, 0, 1, 1, 1, 0),
    (8, 0.0, 2, 3, 1.0, 1.0, 0, 3, 0, 0, 0), (40, 0.0, 90, 2, 0, 1.0, 0, 3, 1, 0, 0), (3, 0.5, 90, 90, 0, 0, 0, 3, 1, 0, 0), (10, 0.0, 90, 90, 0, 0, 0, 3, 1, 0, 0), (90, 0.0, 3, 3, 1.0, 1.0, 0, 3, 1, 0, 0), (2, 1.0, 90, 90, 0, 0, 0, 3, 1, 1, 0), (9, 0.9, 60, 60, 0, 0, 0, 3, 1, 0, 0),
    (4, 0.0, 3, 3, 1.0, 1.0, 0, 1, 1, 0, 0), (3, 0.0, 90, 4, 0, 1.0, 0, 1, 0, 0, 0), (20, 0.0, 90, 4, 0, 1.0, 0, 1, 0, 0, 0), (7, 1.0, 90, 90, 0, 0, 0, 1, 1, 0, 0), (3, 0.9, 90, 3, 0, 0, 0, 1, 1, 0, 0), (5, 0.9, 50, 50, 0, 0, 0, 1, 0, 0, 0), (8, 0.0, 4, 3, 1.0, 1.0, 0, 1, 0, 0, 0),
    # names of furniture: short or linked in a main part, and not long outside of one
    (3, 0.0, 60, 60, 0, 0, 0, 2, 1, 0, 0), (8, 0.0, 60, 60, 0, 0, 0, 2, 1, 0, 0), (16, 0.0, 60, 60, 0, 0, 0, 2, 1, 0, 0), (28, 0.0, 60, 60, 0, 0, 0, 2, 1, 0, 0), (30, 0.1, 10, 9, 0, 0, 0, 2, 1, 0, 0), (2, 0.0, 0, 16, 0, 0, 0, 2, 1, 1, 0), (16, 0.0, 0, 60, 0, 0, 0, 2, 1, 0, 0), (16, 0.0, 60, 0, 0, 0, 0, 2, 1, 0, 0),
    (60, 0.9, 60, 60, 0, 0, 0, 2, 1, 0, 0), (120, 0.7, 90, 3, 0, 1.0, 0, 2, 1, 0, 0), (40, 0.6, 3, 3, 1.0, 1.0, 0, 2, 1, 0, 0), (5, 1.0, 4, 4, 1.0, 1.0, 0, 2, 1, 0, 0), (8, 0.0, 3, 3, 1.0, 1.0, 0, 2, 1, 0, 0), (28, 0.0, 3, 3, 1.0, 1.0, 0, 2, 1, 0, 0),
    (8, 0.0, 1, 12, 1.0, 0, 0, 2, 0, 0, 0), (16, 0.0, 60, 60, 0, 0, 0, 2, 0, 0, 0), (60, 0.0, 40, 70, 0, 0, 0, 2, 0, 0, 0), (100, 0.0, 10, 10, 0, 0, 0, 2, 0, 0, 0), (90, 0.1, 3, 3, 1.0, 1.0, 0, 2, 0, 0, 0), (200, 0.8, 3, 3, 1.0, 1.0, 0, 2, 0, 0, 0), (3, 0.0, 60, 4, 0, 1.0, 0, 2, 0, 1, 0), (6, 1.0, 60, 0, 0, 0, 0, 2, 0, 0, 0), (16, 0.0, 90, 4, 0, 1.0, 0, 2, 0, 0, 0),
    # names of furniture: outvoted by long text without links
    (40, 0.0, 60, 60, 0, 0, 0, 2, 1, 0, 1), (38, 0.0, 90, 90, 0, 0, 0, 2, 1, 0, 1), (45, 0.1, 10, 60, 0, 0, 0, 2, 1, 0, 1), (100, 0.0, 60, 60, 0, 0, 0, 2, 1, 0, 1), (100, 0.0, 0, 60, 0, 0, 0, 2, 1, 0, 1), (60, 0.2, 3, 3, 1.0, 1.0, 0, 2, 1, 0, 1), (300, 0.05, 60, 0, 0, 0, 0, 2, 1, 0, 1), (40, 0.0, 90, 2, 0, 1.0, 0, 2, 1, 0, 1), (50, 0.0, 0, 0, 0, 0, 0, 2, 1, 0, 1),
    (200, 0.0, 60, 60, 0, 0, 0, 2, 0, 0, 1), (160, 0.1, 3, 3, 1.0, 1.0, 0, 2, 0, 0, 1), (400, 0.0, 0, 0, 0, 0, 0, 2, 0, 0, 1),
    # beside a main part: whatever it is
    (1, 1.0, 1, 1, 1.0, 1.0, 0, 0, -1, 0, 0), (8, 0.0, 1, 12, 1.0, 0, 0, 0, -1, 0, 0), (12, 0.0, 60, 60, 0, 0, 0, 0, -1, 0, 0), (16, 0.0, 60, 3, 0, 1.0, 0, 0, -1, 0, 0), (30, 0.1, 0, 40, 0, 0, 0, 0, -1, 0, 0), (60, 0.0, 10, 80, 0, 0, 0, 0, -1, 0, 0), (120, 0.0, 60, 60, 0, 0, 0, 0, -1, 0, 0), (5, 0.0, 40, 60, 0, 0, 0, 0, -1, 1, 0), (3, 0.0, 0, 50, 0, 0, 0, 0, -1, 1, 0), (20, 0.0, 60, 60, 0, 0, 0, 1, -1, 0, 0), (100, 0.0, 60, 60, 0, 0, 0, 2, -1, 0, 0), (90, 0.0, 60, 60, 0, 0, 0, 1, -1, 0, 0), (300, 0.0, 60, 60, 0, 0, 0, 2, -1, 0, 0), (300, 0.0, 60, 60, 0, 0, 0, 0, -1, 0, 0), (18, 0.0, 40, 40, 0, 0, 0, 0, -1, 0, 0), (2, 0.0, 60, 40, 0, 0, 0, 0, -1, 0, 0),
    # names that content has too: outvoted by whole sentences
    (16, 0.0, 60, 60, 0, 0, 0, 1, 1, 0, 1), (11, 0.0, 60, 60, 0, 0, 0, 1, 1, 0, 1), (40, 0.05, 10, 70, 0, 0, 0, 1, 1, 0, 1), (120, 0.0, 60, 0, 0, 0, 0, 1, 1, 0, 1), (14, 0.0, 8, 16, 0, 0, 0, 1, 1, 0, 1), (22, 0.1, 0, 0, 0, 0, 0, 1, 1, 0, 1),
    (90, 0.0, 60, 60, 0, 0, 0, 1, 0, 0, 1), (60, 0.0, 80, 70, 0, 0, 0, 1, 0, 0, 1), (150, 0.05, 3, 40, 1.0, 0, 0, 1, 0, 0, 1),
    (14, 0.0, 90, 4, 0, 1.0, 0, 1, 1, 0, 1), (40, 0.0, 3, 3, 1.0, 1.0, 0, 1, 1, 0, 1), (90, 0.0, 90, 3, 0, 1.0, 0, 1, 0, 0, 1), (70, 0.1, 3, 3, 1.0, 1.0, 0, 1, 0, 0, 1),
    # blocks of the main part
    (10, 0.0, 9, 60, 0, 0, 0, 0, 1, 1, 1), (3, 0.0, 0, 50, 0, 0, 0, 0, 1, 1, 1), (5, 0.0, 40, 60, 0, 0, 0, 0, 1, 1, 1), (60, 0.0, 10, 80, 0, 0, 0, 0, 1, 0, 1),
    (2, 0.0, 60, 70, 0, 0, 0, 0, 1, 0, 1), (1, 0.0, 0, 0, 0, 0, 0, 0, 1, 0, 1), (120, 0.05, 60, 9, 0, 0, 0, 0, 1, 0, 1), (30, 0.3, 60, 60, 0, 0, 0, 0, 1, 0, 1),
    (8, 0.6, 60, 60, 0, 0, 0, 0, 1, 0, 1), (200, 0.0, 2, 30, 0, 0, 0, 0, 1, 0, 1), (4, 0.0, 3, 5, 0, 0, 0, 0, 1, 0, 1), (1, 1.0, 50, 40, 0, 0, 0, 0, 1, 0, 1),
    (3, 0.0, 1, 8, 1.0, 0, 0, 0, 1, 0, 1), (1, 0.0, 8, 1, 0, 1.0, 0, 0, 1, 0, 1), (6, 1.0, 8, 60, 0, 0, 0, 0, 1, 1, 1), (12, 0.9, 60, 60, 0, 0, 0, 0, 1, 0, 1),
    (10, 0.5, 16, 16, 0, 0, 0, 0, 1, 0, 1), (20, 0.45, 8, 10, 0, 0, 0, 0, 1, 0, 1), (15, 0.7, 16, 5, 0, 0, 0, 0, 1, 0, 1), (5, 1.0, 16, 16, 0, 0, 0, 0, 1, 0, 1), (1, 1.0, 6, 6, 0, 0, 0, 0, 1, 0, 1), (3, 0.9, 6, 8, 0, 0, 0, 0, 1, 0, 1), (2, 1.0, 40, 6, 0, 0, 0, 0, 1, 0, 1), (1, 0.9, 100, 100, 0, 0, 0, 0, 1, 1, 1), (30, 0.8, 20, 12, 0.3, 0, 0, 0, 1, 0, 1), (3, 1.0, 16, 3, 0, 0, 0, 0, 1, 0, 1),
    (60, 0.0, 60, 3, 0, 1.0, 0, 0, 1, 0, 1), (30, 0.0, 90, 2, 0, 1.0, 0, 0, 1, 0, 1), (1, 0.0, 90, 4, 0, 1.0, 0, 0, 1, 0, 1), (8, 0.0, 70, 3, 0, 1.0, 0, 0, 1, 0, 1), (5, 0.1, 3, 3, 1.0, 1.0, 0, 0, 1, 0, 1), (3, 0.0, 40, 3, 0, 1.0, 0, 0, 1, 0, 1), (3, 0.0, 2, 3, 0, 1.0, 0, 0, 1, 1, 1),
    # runs of links in the main part
    (3, 1.0, 4, 4, 1.0, 1.0, 0, 0, 1, 0, 0), (5, 1.0, 3, 5, 1.0, 1.0, 0, 0, 1, 0, 0), (6, 0.95, 5, 6, 1.0, 0.95, 0, 0, 1, 0, 0),
    # unmarked pages: text
    (60, 0.0, 10, 80, 0, 0, 0, 0, 0, 0, 1), (25, 0.1, 60, 70, 0, 0, 0, 0, 0, 0, 1), (120, 0.05, 0, 0, 0, 0, 0, 0, 0, 0, 1), (18, 0.0, 40, 40, 0, 0, 0, 0, 0, 0, 1),
    (9, 0.0, 50, 60, 0, 0, 0, 0, 0, 0, 1), (8, 0.0, 1, 70, 1.0, 0, 0, 0, 0, 1, 1), (5, 0.0, 60, 80, 0, 0, 0, 0, 0, 1, 1), (40, 0.0, 12, 15, 0, 0, 0, 0, 0, 0, 1),
    (14, 0.0, 30, 3, 0, 0, 0, 0, 0, 0, 1), (16, 0.0, 16, 1, 0, 1.0, 0, 0, 0, 0, 1), (16, 0.0, 16, 4, 0, 1.0, 0, 0, 0, 0, 1), (30, 0.1, 2, 2, 1.0, 1.0, 0, 0, 0, 0, 1),
    (7, 0.0, 30, 2, 0, 1.0, 0, 0, 0, 0, 1), (2, 0.0, 60, 40, 0, 0, 0, 0, 0, 0, 1), (3, 0.0, 30, 20, 0, 0, 0, 0, 0, 0, 1), (2, 0.0, 0, 16, 0, 0, 0, 0, 0, 1, 1), (4, 1.0, 60, 60, 0, 0, 0, 0, 0, 0, 1),
    (20, 0.45, 16, 16, 0, 0, 0, 0, 0, 0, 1), (30, 0.5, 30, 30, 0, 0, 0, 0, 0, 0, 1), (12, 0.45, 20, 20, 0, 0, 0, 0, 0, 0, 1),
    (16, 0.0, 90, 5, 0, 1.0, 0, 0, 0, 0, 1), (100, 0.0, 120, 3, 0, 1.0, 0, 0, 0, 0, 1), (50, 0.1, 60, 4, 0, 0.9, 0, 0, 0, 0, 1), (8, 0.0, 90, 3, 0, 1.0, 0, 0, 0, 0, 1), (8, 0.1, 3, 3, 1.0, 1.0, 0, 0, 0, 0, 1), (9, 0.0, 40, 3, 0, 0.5, 0, 0, 0, 0, 1),
    # unmarked pages: links and scraps among links
    (4, 1.0, 16, 0, 0, 0, 0, 0, 0, 0, 0), (2, 1.0, 80, 1, 0, 1.0, 0, 0, 0, 0, 0), (9, 0.8, 60, 6, 0, 0.8, 0, 0, 0, 0, 0), (25, 0.9, 0, 0, 0, 0, 0, 0, 0, 0, 0), (1, 1.0, 0, 1, 0, 1.0, 0, 0, 0, 0, 0),
    (2, 1.0, 1, 2, 1.0, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 40, 40, 1.0, 1.0, 0, 0, 0, 0, 0), (3, 0.9, 100, 100, 1.0, 1.0, 0, 0, 0, 0, 0), (12, 1.0, 40, 100, 1.0, 1.0, 0, 0, 0, 1, 0), (2, 0.95, 100, 40, 1.0, 1.0, 0, 0, 0, 0, 0), (4, 0.9, 3, 60, 1.0, 0, 0, 0, 0, 0, 0), (12, 0.8, 8, 9, 0.9, 0.9, 0, 0, 0, 0, 0), (30, 0.7, 5, 5, 0.8, 0.8, 0, 0, 0, 0, 0), (5, 0.8, 16, 16, 0, 0, 0, 0, 0, 0, 0),
    (2, 0.0, 1, 2, 1.0, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 3, 4, 0, 1.0, 0, 0, 0, 0, 0), (6, 0.5, 60, 3, 0, 1.0, 0, 0, 0, 0, 0), (15, 0.6, 4, 70, 0.9, 0, 0, 0, 0, 0, 0), (3, 1.0, 16, 16, 0, 0, 0, 0, 0, 1, 0), (4, 1.0, 0, 16, 0, 0, 0, 0, 0, 1, 0),
)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 12) -> tuple:
    """A binary tree by Gini impurity: (feature, cut, left, right) or (label,)."""
    if depth == 0 or len(set(labels.tolist())) == 1:
        return (int(2 * labels.sum() > len(labels)),)
    best: tuple = (1e9,)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = rows[:, f] <= cut
            cost = sum(2 * m.sum() * (p := labels[m].mean()) * (1 - p) for m in (low, ~low))
            if cost < best[0] - 1e-12:
                best = (cost, f, float(cut), low)
    if len(best) == 1:
        return (int(2 * labels.sum() > len(labels)),)
    _, f, cut, low = best
    return (f, cut, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


def trained() -> tuple:
    table = np.array(TABLE, np.float64)
    return grow(table[:, :-1], table[:, -1].astype(int))


def decide(tree: tuple, row: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return bool(tree[0])


def _hint(name: str, attributes: str) -> int:
    """What class, id and role say: 3 advert or comment, 2 furniture, 1
    perhaps, 0 nothing."""
    if not attributes or name in ("body", "html"):
        return 0
    values = [a or b or c for a, b, c in _NAME.findall(attributes)]
    if name in MAIN:
        return 3 * any(map(ASIDE.search, values))
    return next((h for h, names in ((3, FOREIGN), (2, NAMED), (1, VAGUE)) if any(map(names.search, values))), 0)


class Block(NamedTuple):
    text: str = ""
    words: int = 0
    linked: int = 0
    zone: int = 0
    main: bool = False
    heading: bool = False

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


class Page:
    """The blocks of a page in order, and the furniture zones they lie in.

    One pass that looks at each character a bounded number of times: an open
    element is found by its count, and a tag that never ends is searched once.
    Unclosed elements end with an enclosing one; a stray end tag is passed
    over. Text in silent or hidden elements is none. A quoted value that never
    ends is read as if it had no quotes; a tag that never ends is no text.
    """

    def __init__(self, page: str):
        self.page, self.blocks = page, []
        #: parent, in a furniture element, hint, whether it holds a title
        self.zones: list[list] = [[0, False, 0, False]]
        self._stack: list[tuple[str, bool, int, bool, bool, int]] = []
        self._open: Counter[str] = Counter()
        self._state = (False, 0, False, False, 0)  # silent, zone, main, heading, foreign
        self._parts: list[tuple[str, bool]] = []
        self._links, self._quoted = 0, True
        at = 0
        while (at := self._next(at)) < len(page):
            pass
        self._flush()

    def _flush(self) -> None:
        if self._parts:
            text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in self._parts))).strip()
            if text:
                n = text.count(" ") + 1
                linked = sum(len(html.unescape(p).split()) for p, a in self._parts if a)
                _, zone, main, heading, _ = self._state
                self.blocks.append(Block(text, n, min(n, linked), zone, main, heading))
            self._parts.clear()

    def _text(self, start: int, end: int) -> None:
        if start < end and not self._state[0]:
            self._parts.append((self.page[start:end], self._links > 0))

    def _next(self, at: int) -> int:
        """Reads text up to the next mark and the mark; where it ends."""
        page = self.page
        lt = page.find("<", at)
        if lt < 0:
            self._text(at, len(page))
            return len(page)
        m = _NAME_OF.match(page, lt + 1)
        if not m and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            self._text(at, lt + 1)  # a plain <
            return lt + 1
        self._text(at, lt)
        if not m:
            for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if page.startswith(start, lt):
                    end = page.find(stop, lt + len(start) - (start == "<!--") * 2)
                    return len(page) if end < 0 else end + len(stop)
        rest = _REST.match(page, m.end()) if self._quoted else None
        if rest is None:
            self._quoted, end = False, page.find(">", m.end())
            if end < 0:
                return len(page)
        else:
            end = rest.end() - 1
        name = m[2].lower()
        if name in BLOCK:
            self._flush()
        if m[1]:
            self._close(name)
            return end + 1
        return self._start(name, page[m.end() : end], end + 1)

    def _pop(self) -> str:
        name = self._stack.pop()[0]
        self._open[name] -= 1
        self._state = self._stack[-1][1:] if self._stack else (False, 0, False, False, 0)
        return name

    def _close(self, name: str) -> None:
        if name == "a":
            self._links = max(0, self._links - 1)
        elif self._open[name]:
            while self._pop() != name:
                pass

    def _start(self, name: str, attributes: str, at: int) -> int:
        silent, zone, main, heading, foreign = self._state
        if name == "a":
            self._links += 1
            return at
        if name in VOID or (foreign and attributes.endswith("/")):
            return at
        if name in RAW and not foreign:
            end = _RAW_END[name].search(self.page, at)
            end = self.page.find(">", end.end()) if end else -1
            return len(self.page) if end < 0 else end + 1
        if name in BLOCK or name in SILENT:
            if name in SELF_ENDING and self._stack and self._stack[-1][0] == name:
                self._pop()
                silent, zone, main, heading, foreign = self._state
            element, hint = name in FURNITURE and not (name == "header" and main), _hint(name, attributes)  # an article's own header holds its title
            if element or hint:
                self.zones.append([zone, element, hint, False])
                zone = len(self.zones) - 1
            if name == "h1" or name in MAIN:
                self.zones[zone][3] = True
            self._state = (silent or name in SILENT or bool(attributes and _HIDDEN.search(attributes)), zone, main or name in MAIN, heading or (name[0] == "h" and name[1:].isdigit()), foreign + (name in ("svg", "math")))
            self._stack.append((name, *self._state))
            self._open[name] += 1
        return at

    def furniture(self) -> list[tuple[bool, int]]:
        """Per zone: in a furniture element, and the greatest hint, of all
        zones around it that don't surround the page."""
        plain, titled = [0] * len(self.zones), [z[3] for z in self.zones]
        for b in self.blocks:
            plain[b.zone] += b.words - b.linked
        for i in range(len(self.zones) - 1, 0, -1):
            parent = self.zones[i][0]
            plain[parent] += plain[i]
            titled[parent] |= titled[i]
        out = [(False, 0)]
        for i, (parent, element, hint, _) in enumerate(self.zones[1:], 1):
            around = (titled[i] and 2 * plain[i] >= plain[0] > 0) or (plain[i] >= BODY_WORDS and 20 * plain[i] >= 19 * plain[0] and not element)
            e, h = out[parent]
            out.append((e, h) if around else (e or element, max(h, hint)))
        return out

    def features(self) -> list[tuple]:
        """A row of the table for each block."""
        zones, none, found = self.furniture(), Block(), self.blocks
        # articles mark the main part where most words are theirs, not where they are cards beside it
        weight = [0, 0]
        for b in found:
            if zones[b.zone] == (False, 0):
                weight[b.main] += b.words - b.linked
        marked = weight[1] >= weight[0] and weight[1] > 0
        out = []
        for i, b in enumerate(found):
            before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
            element, hint = zones[b.zone]
            main = (1 if b.main else -1) if marked else 0
            if main < 1 and b.words <= LEGAL_WORDS and LEGAL.search(b.text):
                hint = max(hint, 2)
            out.append((b.words, b.density, before.words, after.words, before.density, after.density, element, hint, main, b.heading))
        return out


def main_text(page: str | None, tree: tuple) -> str:
    if not page:
        return ""
    p = Page(page)
    return " ".join(b.text for b, row in zip(p.blocks, p.features(), strict=True) if decide(tree, row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars per row.

    Null and empty pages give an empty text of 0 characters, as do pages
    without a content block. Very long and broken pages are read whole, in time
    proportional to their length. Malformed UTF-8 becomes U+FFFD. Repeated rows
    give equal rows, an empty table no row. Other columns aren't looked at.
    """
    prepare(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(decoded(t), tree) if t else "" for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("html")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
