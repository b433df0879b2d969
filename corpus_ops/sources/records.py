"""Bytes to text, and structured objects to records."""

from __future__ import annotations

import codecs
import json
import unicodedata
from typing import NamedTuple

#: Byte-order marks with their encodings, the longer ones first.
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
#: Names of fields, in order of preference.
TURN_LISTS = ("messages", "conversations", "conversation", "turns", "dialog", "dialogue")
PAIRS = (("instruction", "output"), ("instruction", "response"), ("prompt", "completion"), ("prompt", "response"), ("question", "answer"), ("query", "response"), ("input", "output"))
PROSE = ("text", "content", "body", "document", "article", "raw", "page_content")
ROLE_FIELDS, CONTENT_FIELDS = ("role", "from", "speaker"), ("content", "value", "text", "message")
ALIASES = {"human": "user", "prompter": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "system": "system"}
#: A lone field must be longer than this to be a text.
LONE = 32


class Record(NamedTuple):
    source: str
    text: str | None = None
    messages: list[dict] | None = None
    meta: dict[str, str] | None = None


class Skip(Exception):
    """A file that gives nothing, with the reason."""


def decode(raw: bytes) -> str:
    """Text of bytes in any encoding; never fails. A detector is asked between UTF-8 and the Western code pages if one is installed."""
    marked = next((name for mark, name in MARKS if raw.startswith(mark)), None)
    for name in [*([marked] if marked else []), "utf-8", None, "cp1252"]:
        try:
            if name or (name := _detected(raw)):
                return raw.decode(name).lstrip("﻿" if marked else "")
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("latin-1")


def _detected(raw: bytes) -> str | None:
    try:
        import chardet
    except ImportError:
        return None
    guess = chardet.detect(raw)
    return guess["encoding"] if guess.get("encoding") and (guess.get("confidence") or 0) >= 0.8 else None


def normal(text: str) -> str:
    """Composed characters, one kind of line end, no control or unassigned characters but tabs."""
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii() and text.isprintable():
        return text
    return "".join(c for c in text if c in "\n\t" or not unicodedata.category(c).startswith("C"))


def _said(value) -> bool:
    return isinstance(value, str) and bool(value.strip())


def turn(item) -> dict | None:
    if not isinstance(item, dict):
        return None
    roles = [item[k] for k in ROLE_FIELDS if item.get(k)]
    contents = [item[k] for k in CONTENT_FIELDS if isinstance(item.get(k), str)]
    return {"role": ALIASES.get(str(roles[0]).strip().lower(), "user"), "content": contents[0]} if roles and contents else None


def _pair(item: dict) -> list[dict] | None:
    for ask, reply in PAIRS:
        if _said(item.get(ask)) and _said(item.get(reply)):
            question = item[ask] + (f"\n\n{item['input']}" if ask != "input" and _said(item.get("input")) else "")
            head = [{"role": "system", "content": item["system"]}] if _said(item.get("system")) else []
            return [*head, {"role": "user", "content": question}, {"role": "assistant", "content": item[reply]}]
    return None


def mapped(item: dict, source: str) -> Record | None:
    """The record an object stands for: a conversation, a pair, prose, or its one long string; None for mere metadata."""
    for key in TURN_LISTS:
        if isinstance(item.get(key), list) and (found := [t for x in item[key] if (t := turn(x))]):
            return Record(source, messages=found)
    if pair := _pair(item):
        return Record(source, messages=pair)
    prose = [item[k] for k in PROSE if _said(item.get(k))] or [v for v in item.values() if isinstance(v, str) and len(v.strip()) > LONE]
    return Record(source, text=prose[0]) if len(prose) == 1 or any(_said(item.get(k)) for k in PROSE) else None


def from_value(value, source: str) -> Record | None:
    """The record of one JSON value; numbers and lists have none."""
    if isinstance(value, str):
        return Record(source, text=value)
    return mapped(value, source) if isinstance(value, dict) else None


def from_json(text: str, source: str) -> Record | None:
    try:
        return from_value(json.loads(text), source)
    except (ValueError, RecursionError):
        return None
