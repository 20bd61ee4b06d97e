"""The second dialect of hook payloads: triggers, tools, servers, lineage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What triggers are called, and words that tell kinds of tools.
TRIGGERS = {
    "sessionstart": "SessionStart", "agentspawn": "SessionStart", "userpromptsubmit": "UserPromptSubmit", "promptsubmit": "UserPromptSubmit", "pretooluse": "PreToolUse",
    "posttooluse": "PostToolUse", "stop": "Stop", "agentstop": "Stop", "sessionend": "SessionEnd", "pretaskexec": "PreTaskExec", "posttaskexec": "PostTaskExec",
    "postfilecreate": "PostFileCreate", "postfilesave": "PostFileSave", "postfiledelete": "PostFileDelete", "manual": "Manual",
}
SPAWNING = ("invoke_sub_agent", "subagent_response")
CATEGORIES = ("read", "write", "shell", "web", "spec")
TOOL_WORDS = [
    ("shell", ("bash", "shell", "execute", "exec", "terminal", "command")),
    ("web", ("web", "http", "https", "fetch", "browse", "url")),
    ("write", ("write", "replace", "edit", "delete", "create", "append", "rename", "patch", "remove", "move")),
    ("read", ("read", "grep", "glob", "list", "find", "search", "view", "open", "ls", "code")),
]


def trigger(name: Column) -> Column:
    """A trigger under its usual name, however it is spelt; others as they are."""
    known = F.create_map(*[F.lit(x) for kv in TRIGGERS.items() for x in kv])
    return F.when(F.length(F.trim(name)) > 0, F.coalesce(known[F.regexp_replace(F.lower(name), "[^a-z0-9]", "")], name)).otherwise("unknown")


def server_name(name: Column) -> Column:
    """A server's configured name as it stands in tool ids."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"[\s-]", "_"), "[^a-zA-Z0-9_]", ""))


def tool_kind(tool: Column) -> Column:
    """``mcp`` for tools of servers, else by the id, its category or the first
    kind that one of its whole words tells; ``other`` if none does."""
    name = F.coalesce(tool, F.lit(""))
    words = F.transform(F.regexp_extract_all(name, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+)"), 1), lambda w: F.lower(w))
    served = name.rlike(r"^mcp__.*__") | name.rlike(r"^mcp_[^_].*_|^mcp_.+_") | name.rlike("^@.*/")
    kind = F.when(served, "mcp").when(name.isin(*SPAWNING), "spawn").when(F.lower(name).isin(*CATEGORIES), F.lower(name))
    for k, hints in TOOL_WORDS:
        kind = kind.when(F.arrays_overlap(words, F.array(*[F.lit(h) for h in hints])), k)
    return kind.otherwise("other")


def lineage(session: Column, root: Column) -> Column:
    """(root, child): whether a session belongs to another one."""
    child = (F.length(F.trim(root)) > 0) & (root != session)
    return F.struct(F.when(child, root).otherwise(session).alias("root"), F.coalesce(child, F.lit(False)).alias("child"))
