"""What a feed is: format, codec, the tag of its records, the array that holds them. Works on a bounded beginning of the feed."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from siftline.functions.names import strip_namespace
from siftline.sources import objects
from siftline.sources.markup import EMPTY, END, HTML_TAGS, START, events

HEAD, WIDE_HEAD, DEFAULT_TAG = 512 << 10, 5 << 20, "job"
#: Elements that hold the records of a feed, scores of names that records go by, and keys of record arrays.
ROOT_CONTAINERS = frozenset("root root-node source sources jobs jobfeed feed feeds channel rss document results response data catalog items postings vacancies openings positions listings records array".split())
KEYWORDS = {"job": 100, "posting": 90, "position": 90, "vacancy": 90, "opening": 90, "opportunity": 85, "listing": 85, "career": 80, "offer": 80, "item": 75, "entry": 75, "record": 70, "requisition": 70, "work": 60}
ARRAY_KEYS = ("data", "jobs", "postings", "vacancies", "results", "items", "records", "positions", "listings", "offers", "jobfeed", "elements")
DEPTH_SCORE = {1: 40, 2: 35, 3: -40}
CODECS = ((".tar.gz", "tar"), (".tgz", "tar"), (".gz", "gzip"), (".gzip", "gzip"), (".bz2", "bzip2"), (".zip", "zip"))


def format_of_bytes(head: bytes) -> str:
    """xml, json or auto, by the first character that is not white space."""
    first = head.removeprefix(b"\xef\xbb\xbf").lstrip()[:1]
    return "xml" if first == b"<" else "json" if first in (b"{", b"[") else "auto"


def format_of_name(name: str) -> str:
    low = name.lower()
    if ".xml" in low:
        return "xml"
    return "json" if any(x in low for x in (".json", ".ndjson", ".jsonl")) else "auto"


def sniff_format(head: bytes, name: str) -> str:
    """By content, else by name, else XML."""
    found = format_of_bytes(head)
    found = format_of_name(name) if found == "auto" else found
    return "xml" if found == "auto" else found


def codec_of(name: str) -> str | None:
    low = name.lower()
    return next((codec for end, codec in CODECS if low.endswith(end)), None)


def keyword_score(tag: str) -> int:
    return KEYWORDS.get(tag, 0)


def detect_record_tag(text: str) -> str | None:
    """The name of the element that records are, as first written: of all that may be one the best by name, parents,
    depth, number of different children and of occurrences; of equally good ones the first by name. None if none may be."""
    spelled: dict[str, str] = {}
    begun, ended, depth = Counter(), Counter(), {}
    parents, children = defaultdict(set), defaultdict(set)
    open_: list[str] = []
    for kind, raw, _ in events(text):
        if kind not in (START, END, EMPTY):
            continue
        name = strip_namespace(raw)
        tag = name.lower()
        if kind == END:
            if tag in open_:
                del open_[len(open_) - 1 - open_[::-1].index(tag) :]
            ended[tag] += 1
            continue
        spelled.setdefault(tag, name)
        begun[tag] += 1
        ended[tag] += kind == EMPTY
        depth[tag] = min(depth.get(tag, len(open_)), len(open_))
        if open_:
            parents[tag].add(open_[-1])
            children[open_[-1]].add(tag)
        if kind == START:
            open_.append(tag)

    def score(tag: str) -> float:
        by_parent = sum(60 * (p in ROOT_CONTAINERS) + 90 * (p in (f"{tag}s", f"{tag}es")) - 80 * (keyword_score(p) > 0 and p not in HTML_TAGS) for p in parents[tag])
        return keyword_score(tag) + by_parent + DEPTH_SCORE.get(depth[tag], -80) + min(5 * len(children[tag]), 50) + 5 * math.log2(max(begun[tag], ended[tag]) + 1)

    fit = [t for t in spelled if t not in HTML_TAGS and depth[t] > 0 and (children[t] or keyword_score(t) > 0)]
    return spelled[min(fit, key=lambda t: (-score(t), t))] if fit else None


def _array_behind(text: str, key: str) -> int | None:
    """Where the array begins that is the value of a key's first occurrence."""
    at = text.lower().find(f'"{key.lower()}"')
    if at < 0:
        return None
    m = re.compile(r"\s*:[\s:]*\[").match(text, at + len(key) + 2)
    return m.end() if m else None


def record_array(head: str, record_tag: str | None = None) -> int | None:
    """Where, behind its bracket, the array of records begins: at the root, behind the key that is asked for, behind a
    usual key, else behind the first key whose value is an array. None if the feed is a row of objects.

    An object that ends on its first line, before the text does, is a record itself: its arrays are its own.
    """
    lead = len(head) - len(head.lstrip("﻿ \t\r\n"))
    body = head[lead:]
    if body.startswith("["):
        return lead + 1
    if not body.startswith("{"):
        return None
    first_line, _, more = body.partition("\n")
    if more.strip() and isinstance(objects.load(first_line), dict):
        return None
    for key in ([record_tag] if record_tag else []) + list(ARRAY_KEYS):
        if (at := _array_behind(head, key)) is not None:
            return at
    m = re.compile(r'"(?:[^"\\]|\\.)*"\s*:\s*\[').search(head[: 1 << 16])
    return m.end() if m else None
