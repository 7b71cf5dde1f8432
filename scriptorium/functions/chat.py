"""Chat messages as ``array<struct<role, content>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): the system message of the chat helper.
SYSTEM_MESSAGE = "You are a helpful AI assistant."

# Rendering template of one message; {role} and {content} are filled per message.
PHI_TEMPLATE = "<|{role}|>\n{content}<|end|>\n"


def message(role: str | Column, content: Column) -> Column:
    r = role if isinstance(role, Column) else F.lit(role)
    return F.struct(r.alias("role"), content.alias("content"))


def alternate_roles(contents: Column, system: str | None = SYSTEM_MESSAGE) -> Column:
    """System message first, then user / assistant alternating by position."""
    msgs = F.transform(contents, lambda c, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), c))
    if system is None:
        return msgs
    return F.concat(F.array(message("system", F.lit(system))), msgs)


def render(messages: Column, template: str = PHI_TEMPLATE) -> Column:
    """One text column from a message array (Q10); template is a parameter."""
    pre, rest = template.split("{role}", 1)
    mid, post = rest.split("{content}", 1)
    return F.array_join(
        F.transform(messages, lambda m: F.concat(F.lit(pre), m["role"], F.lit(mid), m["content"], F.lit(post))),
        "")
