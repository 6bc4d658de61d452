"""Schemas of the layers (nanosecond times stay integers: Spark has µs)."""

from __future__ import annotations

FILES = ("path string, kind string, size bigint, mtime_ns bigint, "
         "inode bigint, dev bigint")
HASHED_FILES = FILES + ", content_hash string, hash_source string"
JOURNAL = "path string, state string"
SCOPE_RULES = "path string, mode string"
IGNORE_FILES = "base string, text string"
CONTENT = ("path string, size bigint, mtime_ns bigint, sha256 string, "
           "text string, reason string")
EDGES = "src string, dst string, kind string, method string, confidence double"
VECTORS = "sha256 string, ord int, vector array<float>"
EVENTS = "ts timestamp, path string, mask int"
PROJECTS = ("project_id string, path string, state string, watch boolean, "
            "root_dev bigint, root_inode bigint")
SNAPSHOTS = "project_id string, snapshot_id string, taken_at timestamp"
META = "store string, key string, value string"
GOLD = "id string, class string, query string, targets array<string>"

# Fixed vocabulary: kinds of catalogue rows, journal states, scope modes and
# tree states, reasons for unread content, freshness states.
FILE, DIR, LINK, OTHER = "file", "dir", "link", "other"
ADDED, REMOVED, UNCHANGED, CHANGED, TOUCHED, UNCONFIRMED = (
    "added", "removed", "unchanged", "changed", "touched", "unconfirmed")
JOURNAL_STATES = (ADDED, REMOVED, UNCHANGED, CHANGED, TOUCHED, UNCONFIRMED)
PENDING_STATES = (ADDED, CHANGED, TOUCHED, UNCONFIRMED)
INCLUDE, EXCLUDE = "include", "exclude"
CHECKED, UNCHECKED, PARTIAL = "checked", "unchecked", "partial"
TOO_LARGE, UNREADABLE, ENCRYPTED, BINARY, UNDECODABLE = (
    "too_large", "unreadable", "encrypted", "binary", "undecodable")
FRESH, STALE, UNREAD, UNEMBEDDED = "fresh", "stale", "unread", "unembedded"
FRESHNESS_STATES = (FRESH, STALE, UNREAD, UNEMBEDDED)
COMPARED, BACKFILLED = "compared", "backfilled"
