"""Import profiles: how source fields become records. Configuration, not data."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from .functions.normalize import SEVERITIES

CANONICAL = ("timestamp", "severity", "subsystem", "event_code", "entity_id", "message")
FORMATS = ("json-lines", "structured-json", "xml", "regex-text", "key-value", "syslog", "iis-w3c", "csv", "tsv")

# Names of source fields and of profile keys that files of profiles use.
DEFAULT_PATHS = {"timestamp": "timestamp", "severity": "level", "subsystem": "subsystem", "event_code": "eventCode", "entity_id": "entityId", "message": "message"}
JSON_PATHS = {"timestamp": "timestampPath", "severity": "severityPath", "subsystem": "subsystemPath", "event_code": "eventCodePath", "entity_id": "entityIdPath", "message": "messagePath"}


@dataclass(frozen=True)
class Profile:
    """canonical: dot path of each canonical field, empty for none. custom: name -> dot path."""

    name: str = ""
    format_id: str = "json-lines"
    canonical: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_PATHS))
    custom: dict[str, str] = field(default_factory=dict)
    severity_aliases: dict[str, str] = field(default_factory=dict)
    timestamp_rules: tuple[str, ...] = ("iso8601",)
    preserve_unmapped: bool = True
    record_path: str = ""
    pattern: str = ""

    def path(self, canonical: str) -> str:
        return self.canonical.get(canonical, "").strip()

    def mapped(self) -> list[str]:
        """Every dot path that the profile uses."""
        return sorted({p.strip() for p in [*self.canonical.values(), *self.custom.values()] if p.strip()})


def problems(profile: Profile) -> list[str]:
    """What keeps a profile from being used; empty if nothing does."""
    found = []
    if profile.format_id not in FORMATS:
        found.append(f"unknown format: {profile.format_id}")
    if profile.format_id == "regex-text":
        try:
            if not re.compile(java_to_python(profile.pattern)).groupindex:
                found.append("the pattern has no named captures")
        except re.error as e:
            found.append(f"INVALID_REGEX_PATTERN: {e}")
    for name, label in profile.severity_aliases.items():
        if label not in SEVERITIES:
            found.append(f"alias {name} has an unknown severity: {label}")
    names = [n.strip().lower() for n in profile.custom]
    if "" in names or len(set(names)) < len(names):
        found.append("custom field names must be there and differ")
    if not profile.timestamp_rules and profile.path("timestamp"):
        found.append("no timestamp rule")
    for p in [*profile.canonical.values(), *profile.custom.values(), profile.record_path]:
        if p.strip() and "" in p.strip().split("."):
            found.append(f"empty segment in path: {p}")
    return found


def java_to_python(pattern: str) -> str:
    return re.sub(r"\(\?<(?![=!])", "(?P<", pattern)


def to_json(profile: Profile) -> str:
    rules = [{"type": "iso8601"} if r == "iso8601" else {"type": "qt-format", "format": r} for r in profile.timestamp_rules]
    out = {"schemaVersion": 1, "name": profile.name, "importerId": profile.format_id, "canonicalFields": {JSON_PATHS[k]: profile.canonical.get(k, "") for k in CANONICAL}, "customFields": [{"name": n, "sourcePath": p} for n, p in profile.custom.items()], "severityAliases": profile.severity_aliases, "timestampRules": rules, "preserveUnmappedFields": profile.preserve_unmapped}
    return json.dumps(out | {k: v for k, v in (("recordPath", profile.record_path), ("regexPattern", profile.pattern)) if v})


def from_json(text: str) -> Profile:
    """A profile from its JSON form; other versions than 1 raise ValueError."""
    d = json.loads(text)
    if d.get("schemaVersion") != 1:
        raise ValueError(f"unsupported schemaVersion: {d.get('schemaVersion')}")
    fields = d.get("canonicalFields", {})
    canonical = {k: fields.get(j, fields.get(j.removesuffix("Path"), DEFAULT_PATHS[k])) for k, j in JSON_PATHS.items()}
    rules = tuple("iso8601" if r.get("type") == "iso8601" else r.get("format", "") for r in d.get("timestampRules", [{"type": "iso8601"}]))
    labels = {"TRACE": "TRACE", "DEBUG": "DEBUG", "INFO": "INFO", "WARNING": "WARN", "WARN": "WARN", "ERROR": "ERROR", "CRITICAL": "CRITICAL"}
    aliases = {k: labels.get(str(v).upper(), str(v)) for k, v in d.get("severityAliases", {}).items()}
    return Profile(d.get("name", ""), d.get("importerId", "json-lines"), canonical, {c["name"]: c["sourcePath"] for c in d.get("customFields", [])}, aliases, rules, d.get("preserveUnmappedFields", True), d.get("recordPath", ""), d.get("regexPattern", ""))


def _only(**paths: str) -> dict[str, str]:
    return {k: paths.get(k, "") for k in CANONICAL}


# The common log format is a row of words, one in brackets, some in quotes, with blanks between them; the combined one has two more.
WORD, BRACKETED, QUOTED, STATUS, SIZE = "({}[^ ]+)", "\\[({}[^]]+)]", '"({}(?:[^"\\\\]|\\\\.)*)"', "({}[1-9][0-9][0-9])", "({}[0-9]+|-)"
COMMON_LINE = (("remoteAddress", WORD), ("remoteLogname", WORD), ("remoteUser", WORD), ("timestamp", BRACKETED), ("request", QUOTED), ("status", STATUS), ("bytesSent", SIZE))
COMBINED_LINE = (*COMMON_LINE, ("referrer", QUOTED), ("userAgent", QUOTED))


def line_pattern(parts: tuple[tuple[str, str], ...], named: bool = True) -> str:
    """A pattern of a line of such parts; a capture for each, with its name if named."""
    return " +".join(shape.replace("{}", f"?<{name}>" if named else "") for name, shape in parts)


# The paths and field names of the usual web and event logs.
WEB_FIELDS = {"Client Address": "remoteAddress", "Remote Logname": "remoteLogname", "Remote User": "remoteUser", "HTTP Status": "status", "Response Bytes": "bytesSent"}
IIS_FIELDS = {
    "Server IP": "s-ip", "HTTP Method": "cs-method", "URI Stem": "cs-uri-stem", "URI Query": "cs-uri-query", "Server Port": "s-port", "Username": "cs-username", "Client IP": "c-ip",
    "User Agent": "cs(User-Agent)", "Referrer": "cs(Referer)", "HTTP Status": "sc-status", "HTTP Substatus": "sc-substatus", "Win32 Status": "sc-win32-status", "Time Taken (ms)": "time-taken",
}
WINDOWS_FIELDS = {
    "Channel": "System.Channel", "Computer": "System.Computer", "Event Record ID": "System.EventRecordID", "Provider GUID": "System.Provider.@Guid", "Process ID": "System.Execution.@ProcessID", "Thread ID": "System.Execution.@ThreadID",
    "Activity ID": "System.Correlation.@ActivityID", "Related Activity ID": "System.Correlation.@RelatedActivityID", "User ID": "System.Security.@UserID", "Task": "System.Task", "Opcode": "System.Opcode", "Keywords": "System.Keywords",
}
WINDOWS_LEVELS = {"1": "CRITICAL", "2": "ERROR", "3": "WARN", "4": "INFO", "5": "TRACE"}

APACHE_COMMON = Profile("Apache Common Access Log", "regex-text", _only(timestamp="timestamp", message="request"), WEB_FIELDS, {}, ("dd/MMM/yyyy:HH:mm:ss tt",), pattern=line_pattern(COMMON_LINE))
WEB_COMBINED = replace(APACHE_COMMON, name="Apache/Nginx Combined Access Log", custom=WEB_FIELDS | {"Referrer": "referrer", "User Agent": "userAgent"}, pattern=line_pattern(COMBINED_LINE))
IIS_W3C = Profile("IIS W3C Extended Log", "iis-w3c", _only(timestamp="timestamp", message="message"), IIS_FIELDS)
WINDOWS_EVENT = Profile(
    "Windows Event XML", "xml",
    _only(timestamp="System.TimeCreated.@SystemTime", severity="System.Level", subsystem="System.Provider.@Name", event_code="System.EventID", message="RenderingInfo.Message"),
    WINDOWS_FIELDS, WINDOWS_LEVELS,
)
WINDOWS_EVENTS = replace(WINDOWS_EVENT, record_path="Events.Event")
PRESETS = {"apache-common": APACHE_COMMON, "web-combined": WEB_COMBINED, "iis-w3c": IIS_W3C, "windows-event-xml": WINDOWS_EVENT, "windows-event-xml-collection": WINDOWS_EVENTS}
