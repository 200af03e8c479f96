"""Main text of HTML pages: flat blocks classified by a decision tree.

The page is read once, tag by tag. Markup that cannot hold text (scripts, styles,
comments, forms, ...) is skipped, inline tags are dropped, and every other tag
ends a block. A block is described by its word count and link density, and the same
two of the blocks before and after it. Where the page says more, there are further
features: whether an article or main element encloses the block (or another part of
the page), an element or class that names a menu, footer, sidebar, notice, advert or
comments, a heading, a page header. A decision tree, grown at first use from the
labelled table below, decides which blocks are main text. Two thirds of its rows
are of pages without any such element or class, where words and links alone decide;
within an article they tell runs of links from text.

Cases: null html counts as empty; a page without main text gives an empty text;
unclosed, misnested and cut-off tags are read as browsers would, to the end of
the page, but for a quoted attribute that never ends: it ends with the next >;
class words count whole (share, share-buttons), not as parts of other names
(share-price); pages of any length are read whole; repeated rows give repeated rows;
an empty table gives no rows; other columns, with any names, are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Element names of HTML.
SKIPPED = frozenset("script style noscript template iframe object svg math select textarea button form head canvas audio video".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside menu dialog".split())
#: Words that tell what an element is: one of its classes, its id or its role, alone or with a word for a container.
_NAMES = "ad|ads|advert|advertisement|adverts|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumbs?|footer|sidebar|widget|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|share|sharing|social|comments?|disqus|respond|replies|related|recommended|complementary|contentinfo|masthead|toolbar|pagination|pager|search|login|signup"
_HOLDERS = "area|banner|bar|block|body|box|buttons?|container|content|form|icons|inner|items?|links?|list|menu|message|notice|panel|popup|posts|section|sidebar|slot|stories|thread|text|top|bottom|unit|widget|wrap|wrapper"
MARKS = re.compile(rf"(?:^|\s)(?:(?:site|page|main|top|bottom|left|right|global|user|reader)[_-])?(?:{_NAMES})(?:[_-](?:{_HOLDERS}|\d+))*(?:$|\s)", re.I)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|body)(?:$|[\s_-])", re.I)
OPEN = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|[!?/])")
ENDS = re.compile(r">|=\s*([\"'])")
ATTR = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)

FEATURES = ("words", "link_density", "prev_words", "prev_links", "next_words", "next_links", "in_main", "in_boiler", "heading", "in_header")

#: Labelled blocks: the features above, then 1 for main text.
LABELLED = (
    # words, links, words before, links before, words after, links after, article (-1: the page has one elsewhere), boilerplate, heading, page header, keep
    # pages without elements or classes that tell: words and links decide
    (1, 1.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0, 0),
    (1, 1.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0, 0),
    (1, 1.00, 3, 1.00, 5, 0.70, 0, 0, 0, 0, 0),
    (1, 1.00, 3, 1.00, 17, 0.00, 0, 0, 0, 0, 0),
    (2, 0.00, 0, 0.00, 3, 1.00, 0, 0, 0, 0, 0),
    (2, 1.00, 3, 0.00, 1, 1.00, 0, 0, 0, 0, 0),
    (2, 1.00, 3, 1.00, 1, 1.00, 0, 0, 0, 0, 0),
    (2, 1.00, 3, 1.00, 2, 1.00, 0, 0, 0, 0, 0),
    (2, 1.00, 3, 1.00, 7, 0.00, 0, 0, 0, 0, 0),
    (2, 1.00, 7, 1.00, 8, 0.30, 0, 0, 0, 0, 0),
    (2, 1.00, 66, 0.10, 7, 0.00, 0, 0, 0, 0, 0),
    (3, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0, 0, 0),
    (3, 0.00, 1, 1.00, 19, 0.00, 0, 0, 1, 0, 1),
    (3, 0.00, 5, 1.00, 4, 1.00, 0, 0, 1, 0, 0),
    (3, 0.00, 6, 0.00, 29, 0.00, 0, 0, 1, 0, 1),
    (3, 0.00, 7, 0.00, 30, 0.00, 0, 0, 1, 0, 1),
    (3, 0.00, 17, 0.20, 27, 0.00, 0, 0, 1, 0, 1),
    (3, 1.00, 0, 0.00, 2, 1.00, 0, 0, 0, 0, 0),
    (3, 1.00, 1, 1.00, 2, 1.00, 0, 0, 0, 0, 0),
    (3, 1.00, 1, 1.00, 3, 1.00, 0, 0, 0, 0, 0),
    (3, 1.00, 2, 1.00, 3, 0.80, 0, 0, 0, 0, 0),
    (3, 1.00, 2, 1.00, 5, 0.00, 0, 0, 0, 0, 0),
    (3, 1.00, 6, 1.00, 4, 1.00, 0, 0, 0, 0, 0),
    (4, 0.00, 0, 0.00, 1, 1.00, 0, 0, 0, 0, 0),
    (4, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0, 0, 0),
    (4, 0.00, 0, 0.00, 3, 1.00, 0, 0, 0, 0, 0),
    (4, 0.00, 2, 1.00, 31, 0.00, 0, 0, 1, 0, 1),
    (4, 0.00, 23, 0.20, 36, 0.00, 0, 0, 1, 0, 1),
    (4, 0.00, 67, 0.00, 23, 0.00, 0, 0, 1, 0, 1),
    (4, 1.00, 1, 0.00, 6, 1.00, 0, 0, 0, 0, 0),
    (4, 1.00, 3, 1.00, 4, 1.00, 0, 0, 0, 0, 0),
    (4, 1.00, 4, 1.00, 1, 0.00, 0, 0, 0, 0, 0),
    (4, 1.00, 8, 0.00, 0, 0.00, 0, 0, 0, 0, 0),
    (4, 1.00, 8, 1.00, 2, 0.00, 0, 0, 0, 0, 0),
    (5, 0.70, 1, 1.00, 17, 0.20, 0, 0, 0, 0, 0),
    (5, 1.00, 6, 1.00, 2, 1.00, 0, 0, 0, 0, 0),
    (6, 0.00, 3, 0.80, 3, 0.00, 0, 0, 0, 0, 0),
    (6, 0.00, 8, 0.30, 0, 0.00, 0, 0, 0, 0, 0),
    (6, 0.00, 36, 0.00, 2, 0.00, 0, 0, 1, 0, 1),
    (6, 0.00, 41, 0.00, 97, 0.10, 0, 0, 0, 0, 1),
    (6, 1.00, 2, 0.00, 3, 1.00, 0, 0, 0, 0, 0),
    (6, 1.00, 7, 1.00, 3, 1.00, 0, 0, 0, 0, 0),
    (7, 0.00, 2, 1.00, 3, 0.00, 0, 0, 0, 0, 0),
    (7, 0.00, 2, 1.00, 13, 0.00, 0, 0, 0, 0, 0),
    (7, 0.00, 4, 0.00, 7, 0.00, 0, 0, 1, 0, 1),
    (7, 0.00, 27, 0.00, 45, 0.05, 0, 0, 0, 0, 1),
    (7, 0.00, 30, 0.20, 60, 0.00, 0, 0, 1, 0, 1),
    (7, 0.00, 45, 0.10, 38, 0.10, 0, 0, 1, 0, 1),
    (7, 1.00, 5, 1.00, 14, 1.00, 0, 0, 0, 0, 0),
    (7, 1.00, 8, 1.00, 6, 0.00, 0, 0, 0, 0, 0),
    (8, 0.00, 6, 0.50, 4, 1.00, 0, 0, 0, 0, 0),
    (8, 1.00, 77, 0.10, 5, 1.00, 0, 0, 0, 0, 0),
    (8, 1.00, 82, 0.05, 7, 1.00, 0, 0, 0, 0, 0),
    (10, 0.50, 14, 1.00, 0, 0.00, 0, 0, 0, 0, 0),
    (11, 0.00, 4, 1.00, 0, 0.00, 0, 0, 0, 0, 0),
    (13, 0.00, 7, 0.00, 0, 0.00, 0, 0, 0, 0, 0),
    (13, 0.20, 1, 1.00, 2, 1.00, 0, 0, 0, 0, 0),
    (13, 0.30, 6, 1.00, 0, 0.00, 0, 0, 0, 0, 0),
    (14, 1.00, 7, 1.00, 10, 0.50, 0, 0, 0, 0, 0),
    (15, 0.20, 37, 0.10, 3, 1.00, 0, 0, 0, 0, 1),
    (17, 0.20, 2, 0.70, 6, 0.00, 0, 0, 0, 0, 0),
    (18, 0.00, 11, 0.00, 66, 0.20, 0, 0, 0, 0, 1),
    (19, 0.00, 3, 0.00, 32, 0.10, 0, 0, 0, 0, 1),
    (21, 0.00, 30, 0.00, 18, 0.20, 0, 0, 0, 0, 1),
    (23, 0.00, 4, 0.00, 45, 0.00, 0, 0, 0, 0, 1),
    (23, 0.20, 2, 1.00, 4, 0.00, 0, 0, 0, 0, 0),
    (23, 0.20, 2, 1.00, 8, 0.00, 0, 0, 0, 0, 0),
    (24, 0.10, 21, 0.05, 60, 0.10, 0, 0, 0, 0, 1),
    (25, 0.00, 46, 0.00, 5, 0.00, 0, 0, 0, 0, 1),
    (27, 0.20, 26, 0.00, 2, 1.00, 0, 0, 0, 0, 1),
    (30, 0.00, 29, 0.05, 2, 0.00, 0, 0, 0, 0, 1),
    (30, 0.00, 43, 0.10, 37, 0.00, 0, 0, 0, 0, 1),
    (30, 0.10, 60, 0.05, 26, 0.00, 0, 0, 0, 0, 1),
    (36, 0.00, 65, 0.00, 6, 0.00, 0, 0, 0, 0, 1),
    (37, 0.00, 14, 0.10, 3, 1.00, 0, 0, 0, 0, 1),
    (37, 0.10, 7, 0.00, 15, 0.20, 0, 0, 0, 0, 1),
    (38, 0.00, 2, 0.00, 30, 0.00, 0, 0, 0, 0, 1),
    (38, 0.10, 7, 0.00, 3, 0.00, 0, 0, 0, 0, 1),
    (41, 0.00, 8, 0.00, 6, 0.00, 0, 0, 0, 0, 1),
    (42, 0.10, 20, 0.05, 18, 0.05, 0, 0, 0, 0, 1),
    (43, 0.10, 7, 0.00, 30, 0.00, 0, 0, 0, 0, 1),
    (45, 0.00, 10, 0.00, 116, 0.00, 0, 0, 0, 0, 1),
    (45, 0.00, 23, 0.00, 7, 0.00, 0, 0, 0, 0, 1),
    (45, 0.00, 65, 0.00, 45, 0.10, 0, 0, 0, 0, 1),
    (45, 0.10, 45, 0.00, 7, 0.00, 0, 0, 0, 0, 1),
    (50, 0.05, 23, 0.00, 4, 0.00, 0, 0, 0, 0, 1),
    (51, 0.00, 53, 0.10, 80, 0.00, 0, 0, 0, 0, 1),
    (53, 0.10, 2, 0.00, 51, 0.00, 0, 0, 0, 0, 1),
    (61, 0.00, 37, 0.00, 75, 0.20, 0, 0, 0, 0, 1),
    (65, 0.00, 115, 0.00, 36, 0.00, 0, 0, 0, 0, 1),
    (66, 0.20, 18, 0.00, 13, 0.00, 0, 0, 0, 0, 1),
    (75, 0.10, 28, 0.00, 115, 0.00, 0, 0, 0, 0, 1),
    (77, 0.10, 18, 0.05, 8, 1.00, 0, 0, 0, 0, 1),
    (80, 0.00, 51, 0.00, 13, 1.00, 0, 0, 0, 0, 1),
    (82, 0.05, 45, 0.05, 8, 1.00, 0, 0, 0, 0, 1),
    (157, 0.10, 52, 0.00, 3, 1.00, 0, 0, 0, 0, 1),
    (42, 0.00, 1, 1.00, 0, 0.00, 0, 0, 0, 0, 1),
    (30, 0.00, 2, 1.00, 60, 0.00, 0, 0, 0, 0, 1),
    (80, 0.00, 1, 1.00, 40, 0.00, 0, 0, 0, 0, 1),
    (27, 0.00, 2, 1.00, 0, 0.00, 0, 0, 0, 0, 1),
    (110, 0.00, 3, 1.00, 0, 0.00, 0, 0, 0, 0, 1),
    (55, 0.10, 2, 1.00, 7, 0.00, 0, 0, 0, 0, 1),
    (20, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 1),
    (36, 0.00, 4, 0.00, 0, 0.00, 0, 0, 0, 0, 1),
    (48, 0.00, 2, 1.00, 1, 1.00, 0, 0, 0, 0, 1),
    (24, 0.10, 1, 1.00, 33, 0.00, 0, 0, 0, 0, 1),
    (65, 0.00, 0, 0.00, 3, 1.00, 0, 0, 0, 0, 1),
    (33, 0.00, 1, 1.00, 28, 0.00, 0, 0, 0, 0, 1),
    (1, 1.00, 1, 1.00, 42, 0.00, 0, 0, 0, 0, 0),
    (2, 1.00, 2, 1.00, 60, 0.00, 0, 0, 0, 0, 0),
    (3, 1.00, 1, 1.00, 30, 0.00, 0, 0, 0, 0, 0),
    # within an article or main element: text of any length, lines that are one link between text
    (120, 0.00, 80, 0.00, 95, 0.00, 1, 0, 0, 0, 1),
    (60, 0.05, 10, 0.00, 70, 0.00, 1, 0, 0, 0, 1),
    (1, 0.00, 40, 0.00, 35, 0.00, 1, 0, 0, 0, 1),
    (3, 0.00, 90, 0.00, 2, 0.00, 1, 0, 0, 0, 1),
    (1, 0.00, 1, 0.00, 1, 0.00, 1, 0, 0, 0, 1),
    (2, 0.00, 3, 0.00, 2, 0.00, 1, 0, 0, 0, 1),
    (6, 0.00, 1, 0.00, 13, 0.00, 1, 0, 0, 0, 1),
    (2, 0.00, 12, 0.00, 0, 0.00, 1, 0, 0, 0, 1),
    (5, 0.00, 5, 0.00, 5, 0.00, 1, 0, 0, 0, 1),
    (4, 0.00, 85, 0.30, 2, 0.00, 1, 0, 0, 0, 1),
    (16, 0.10, 9, 0.00, 4, 0.00, 1, 0, 0, 0, 1),
    (23, 0.00, 0, 0.00, 1, 0.00, 1, 0, 0, 0, 1),
    (9, 0.00, 6, 1.00, 40, 0.00, 1, 0, 0, 0, 1),
    (3, 0.00, 2, 1.00, 4, 1.00, 1, 0, 0, 0, 1),
    (45, 0.00, 2, 1.00, 3, 1.00, 1, 0, 0, 0, 1),
    (8, 0.20, 0, 0.00, 5, 1.00, 1, 0, 0, 0, 1),
    (34, 0.50, 9, 0.30, 8, 0.00, 1, 0, 0, 0, 1),
    (14, 0.60, 60, 0.00, 33, 0.00, 1, 0, 0, 0, 1),
    (11, 0.40, 30, 0.00, 2, 1.00, 1, 0, 0, 0, 1),
    (5, 0.00, 1, 1.00, 0, 0.00, 1, 0, 0, 0, 1),
    (2, 0.00, 4, 1.00, 60, 0.00, 1, 0, 0, 0, 1),
    (70, 0.30, 1, 1.00, 9, 0.00, 1, 0, 0, 0, 1),
    (2, 1.00, 20, 0.20, 25, 0.10, 1, 0, 0, 0, 1),
    (7, 1.00, 12, 0.00, 18, 0.00, 1, 0, 0, 0, 1),
    (14, 0.90, 60, 0.00, 33, 0.00, 1, 0, 0, 0, 1),
    (4, 1.00, 3, 0.00, 0, 0.00, 1, 0, 0, 0, 1),
    (5, 1.00, 0, 0.00, 30, 0.00, 1, 0, 0, 0, 1),
    (9, 0.00, 2, 1.00, 140, 0.00, 1, 0, 1, 0, 1),
    (3, 0.00, 3, 0.00, 24, 0.00, 1, 0, 1, 0, 1),
    (2, 0.00, 2, 0.00, 3, 1.00, 1, 0, 1, 0, 1),
    (5, 0.00, 0, 0.00, 18, 0.00, 1, 0, 1, 0, 1),
    (7, 0.50, 5, 0.00, 40, 0.00, 1, 0, 1, 0, 1),
    (4, 1.00, 30, 0.00, 50, 0.00, 1, 0, 1, 0, 1),
    (7, 0.00, 0, 0.00, 18, 0.00, 1, 0, 1, 1, 1),
    (12, 0.00, 6, 0.00, 30, 0.00, 1, 0, 0, 1, 1),
    (3, 1.00, 25, 0.00, 9, 0.00, 1, 0, 0, 0, 1),
    (6, 1.00, 40, 0.00, 4, 0.00, 1, 0, 0, 0, 1),
    (4, 1.00, 8, 0.00, 12, 0.00, 1, 0, 0, 0, 1),
    (2, 1.00, 15, 0.00, 3, 0.00, 1, 0, 0, 0, 1),
    # there, too: runs of links
    (4, 1.00, 4, 1.00, 4, 1.00, 1, 0, 0, 0, 0),
    (2, 1.00, 1, 1.00, 3, 1.00, 1, 0, 0, 0, 0),
    (6, 1.00, 5, 1.00, 7, 1.00, 1, 0, 0, 0, 0),
    (1, 1.00, 2, 1.00, 2, 1.00, 1, 0, 0, 0, 0),
    (3, 1.00, 40, 0.00, 4, 1.00, 1, 0, 0, 0, 0),
    (5, 1.00, 6, 0.00, 3, 1.00, 1, 0, 0, 0, 0),
    (2, 1.00, 3, 1.00, 50, 0.00, 1, 0, 0, 0, 0),
    (7, 1.00, 4, 1.00, 0, 0.00, 1, 0, 0, 0, 0),
    (9, 1.00, 8, 1.00, 6, 1.00, 1, 0, 0, 0, 0),
    (4, 0.90, 3, 1.00, 90, 0.00, 1, 0, 0, 0, 0),
    (6, 0.80, 2, 0.00, 5, 0.90, 1, 0, 0, 0, 0),
    (12, 1.00, 11, 1.00, 10, 1.00, 1, 0, 0, 0, 0),
    # outside the article of a page that has one
    (9, 0.00, 7, 0.00, 8, 0.00, -1, 0, 0, 0, 0),
    (15, 0.00, 1, 1.00, 3, 0.00, -1, 0, 0, 0, 0),
    (33, 0.00, 0, 0.00, 8, 0.00, -1, 0, 0, 0, 0),
    (90, 0.00, 2, 1.00, 70, 0.00, -1, 0, 0, 0, 0),
    (20, 0.00, 0, 0.00, 1, 1.00, -1, 0, 0, 0, 0),
    (64, 0.00, 2, 0.00, 4, 0.00, -1, 0, 0, 0, 0),
    (31, 0.10, 2, 1.00, 9, 0.00, -1, 0, 0, 0, 0),
    (8, 0.00, 40, 0.00, 44, 0.00, -1, 0, 0, 0, 0),
    (52, 0.00, 88, 0.00, 25, 0.00, -1, 0, 0, 0, 0),
    (3, 0.00, 0, 0.00, 70, 0.00, -1, 0, 0, 0, 0),
    (75, 0.00, 40, 0.00, 60, 0.00, -1, 0, 0, 0, 0),
    (18, 0.00, 33, 0.00, 0, 0.00, -1, 0, 0, 0, 0),
    (4, 1.00, 3, 1.00, 5, 1.00, -1, 0, 0, 0, 0),
    (120, 0.00, 60, 0.00, 90, 0.00, -1, 0, 0, 0, 0),
    (17, 0.00, 1, 0.00, 2, 0.00, -1, 0, 1, 0, 0),
    (24, 0.05, 0, 0.00, 40, 0.00, -1, 0, 0, 1, 0),
    # in a menu, footer, sidebar, notice, advert or comments, in an article or not
    (55, 0.00, 90, 0.00, 30, 0.00, 0, 1, 0, 0, 0),
    (14, 0.00, 80, 0.00, 0, 0.00, 0, 1, 0, 0, 0),
    (41, 0.00, 3, 0.00, 17, 0.00, 0, 1, 0, 0, 0),
    (26, 0.00, 64, 0.00, 50, 0.00, 0, 1, 0, 0, 0),
    (70, 0.10, 0, 0.00, 30, 0.00, 0, 1, 0, 0, 0),
    (9, 0.00, 1, 1.00, 8, 0.00, 0, 1, 0, 0, 0),
    (130, 0.00, 60, 0.00, 75, 0.00, 0, 1, 0, 0, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 1, 0, 0, 0),
    (48, 0.02, 60, 0.00, 12, 0.00, 1, 1, 0, 0, 0),
    (6, 0.50, 70, 0.00, 90, 0.00, 1, 1, 0, 0, 0),
    (3, 0.00, 60, 0.00, 20, 0.00, 1, 1, 0, 0, 0),
    (90, 0.00, 30, 0.00, 40, 0.00, 1, 1, 0, 0, 0),
    (2, 0.00, 3, 0.00, 2, 0.00, 1, 1, 0, 0, 0),
    (21, 0.00, 120, 0.00, 5, 0.00, 1, 1, 0, 0, 0),
    (4, 0.00, 60, 0.00, 20, 0.00, 1, 1, 1, 0, 0),
    # in a page header of a page without an article
    (5, 0.00, 0, 0.00, 1, 1.00, 0, 0, 1, 1, 0),
    (12, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0, 1, 0),
    (25, 0.10, 3, 1.00, 5, 0.90, 0, 0, 0, 1, 0),
)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int = 10) -> tuple:
    """CART with Gini impurity of weighted rows: ("leaf", class) or (feature, threshold, below or at, above)."""
    leaf = ("leaf", int(2 * (w * y).sum() >= w.sum()))
    if depth == 0 or y.min() == y.max():
        return leaf
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            cost = sum(w[m].sum() * (p := np.average(y[m], weights=w[m])) * (1 - p) for m in (left, ~left))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), left)
    if best is None:
        return leaf
    _, f, t, left = best
    return (f, t, grow(x[left], y[left], w[left], depth - 1), grow(x[~left], y[~left], w[~left], depth - 1))


#: Weight of a labelled row where the page itself tells: markup that names what it holds is surer than words and links.
TOLD = 6


@lru_cache(maxsize=4)
def trained(table: tuple = LABELLED) -> tuple:
    rows = np.array(table, dtype=float)
    told = (rows[:, FEATURES.index("in_main")] != 0) | (rows[:, FEATURES.index("in_boiler")] > 0)
    return grow(rows[:, :-1], rows[:, -1], np.where(told, TOLD, 1.0))


def judge(tree: tuple, features: tuple) -> int:
    while tree[0] != "leaf":
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree[1]


class _Tags:
    """The tags of a page in turn: (start, end, closing, name, attributes); comments and declarations have no name."""

    def __init__(self, html: str):
        self.html, self.unclosed = html, set()  # quotes that do not come again

    def _end(self, at: int) -> int:
        """Where the tag ends: after the first > outside a quoted attribute."""
        while m := ENDS.search(self.html, at):
            quote = m.group(1)
            if quote is None:
                return m.end()
            close = -1 if quote in self.unclosed else self.html.find(quote, m.end())
            if close < 0:
                self.unclosed.add(quote)
            at = max(m.end(), close + 1)
        return len(self.html)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        m = OPEN.search(self.html, at)
        if not m:
            return None
        if m.group(1):
            end = self.html.find("-->", m.end())
            return m.start(), end + 3 if end >= 0 else len(self.html), False, "", ""
        if not m.group(3):
            end = self.html.find(">", m.end())
            return m.start(), end + 1 if end >= 0 else len(self.html), False, "", ""
        end = self._end(m.end())
        return m.start(), end, bool(m.group(2)), m.group(3).lower(), self.html[m.end() : end].removesuffix(">")


def blocks(html: str) -> list[tuple[str, float, bool, bool, bool, bool]]:
    """(text, link density, in main, in boilerplate, heading, in page header) of each text block, in page order."""
    out: list = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, main, boiler, heading, header
    state = (False, False, False, False)
    parts, linked, total, links = [], 0, 0, 0
    skip, at, n, tags = 0, 0, len(html), _Tags(html)

    def flush():
        nonlocal parts, linked, total
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, linked / total if total else 0.0, *state))
        parts, linked, total = [], 0, 0

    def put(raw: str):
        nonlocal linked, total
        parts.append(raw)
        words = len(raw.split())
        total += words
        linked += words * bool(links)

    while at < n:
        tag = tags.next(at)
        if not tag:
            if not skip:
                put(html[at:])
            break
        start, end, closing, name, attributes = tag
        if start > at and not skip:
            put(html[at:start])
        at = end
        if not name:
            continue
        if not closing:
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else n
                if name not in INLINE:
                    flush()
                continue
            if name in INLINE:
                links += name == "a"
                continue
            flush()
            if name in VOID or attributes.rstrip().endswith("/"):
                continue
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # closed by the next of its kind
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "main", "td", "body", "aside", "nav"):
                        break
            main, boiler, heading, header = stack[-1][1:] if stack else (False,) * 4
            about = " ".join(x.strip("\"'") for x in ATTR.findall(attributes))
            main = main or name in ("article", "main")
            boiler = boiler or name in BOILER or (name == "header" and not main) or bool(about and name not in ("html", "body", "article", "main") and MARKS.search(about))
            if not boiler and about and name in ("div", "section") and MAIN.search(about):
                main = True
            stack.append((name, main, boiler, heading or name in ("h1", "h2", "h3", "h4", "h5", "h6"), header or name == "header"))
            links = 0
            skip += name in SKIPPED
        elif name in INLINE:
            links = max(0, links - (name == "a"))
            continue
        else:
            if not skip:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    skip -= sum(x[0] in SKIPPED for x in stack[i:])
                    del stack[i:]
                    break
            links = 0
        state = stack[-1][1:] if stack else (False,) * 4
    if not skip:
        flush()
    return out


def main_text(html: str | None, tree: tuple | None = None) -> str:
    tree = tree or trained()
    found = blocks(html or "")
    words = [len(b[0].split()) for b in found]
    has_main = any(b[2] for b in found)
    keep = []
    for i, (text, density, main, boiler, heading, header) in enumerate(found):
        before = (words[i - 1], found[i - 1][1]) if i else (0, 0.0)
        after = (words[i + 1], found[i + 1][1]) if i + 1 < len(found) else (0, 0.0)
        if judge(tree, (words[i], density, *before, *after, main or -has_main, boiler, heading, header)):
            keep.append(text)
    return "\n\n".join(keep)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, then text and n_chars."""
    base = pages.select(*keep, F.col(html).alias("the whole html"))
    schema = base.drop("the whole html").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return map_arrow(base, run, schema)
