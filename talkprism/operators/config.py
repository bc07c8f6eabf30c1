"""Configuration: sources and limits, validated, kept as a JSON file that is replaced atomically."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from talkprism import schema
from talkprism.errors import ConfigurationUnavailable, InvalidRequest
from talkprism.sources.jsonl import Limits, Root, exists, is_folder

#: Fixed value.
VERSION = "0.5.0"


@dataclass(frozen=True)
class InterfaceLimits:
    page_items: int = 64
    preview_bytes: int = 4096
    read_bytes: int = 65_536


@dataclass(frozen=True)
class Configuration:
    roots: tuple[Root, ...] = ()
    repositories: tuple[str, ...] = ()
    archive: str | None = None
    limits: InterfaceLimits = field(default_factory=InterfaceLimits)


def issues(candidate: Configuration) -> list[str]:
    """What is wrong with a configuration, in a fixed order; empty if nothing is."""
    found, seen = [], set()
    ceiling = asdict(Limits())
    if not candidate.roots:
        found.append("MissingTranscriptSource")
    for root in candidate.roots:
        if root.source not in schema.SOURCES[:5]:
            found.append(f"UnknownSource:{root.source}")
        if not root.path:
            found.append("EmptyPath")
        if not root.identifier:
            found.append("EmptyIdentifier")
        if (root.source, root.identifier) in seen:
            found.append(f"RepeatedSource:{root.source}:{root.identifier}")
        seen.add((root.source, root.identifier))
        found += [f"ZeroLimit:{k}" for k, v in asdict(root.limits).items() if v is not None and v <= 0]
        found += [f"LimitAboveCeiling:{k}" for k, v in asdict(root.limits).items() if v is None or v > ceiling[k]]
    found += [f"ZeroLimit:{k}" for k, v in asdict(candidate.limits).items() if v <= 0]
    found += [f"LimitAboveCeiling:{k}" for k, v in asdict(candidate.limits).items() if v > asdict(InterfaceLimits())[k]]
    found += ["EmptyRepository" for r in candidate.repositories if not r]
    if candidate.archive is not None and (os.path.isabs(candidate.archive) or ".." in candidate.archive.split("/")):
        found.append("ArchivePathLeavesRoot")
    return found


def _plain(path: str) -> str:
    """A path to compare: without a local scheme, normalised, with one slash at its end."""
    own = path.removeprefix("file://").removeprefix("file:")
    scheme, colon, rest = own.partition("://")
    return scheme + colon + os.path.normpath(rest).rstrip("/") + "/" if colon else os.path.normpath(own).rstrip("/") + "/"


def place_issues(spark: SparkSession, candidate: Configuration, index: str) -> list[str]:
    """What is wrong with the places of a configuration and of the index's folder, on the file system that Spark reads: roots that aren't folders, an index inside a root, an index below a file. ``issues`` tells of empty paths."""
    paths = [r.path for r in candidate.roots if r.path]
    found = [f"UnreadablePath:{p}" for p in paths if not is_folder(spark, p)]
    found += [f"IndexInsideSource:{p}" for p in paths if _plain(index).startswith(_plain(p))]
    above = _plain(index).rstrip("/").rpartition("/")[0]
    if above and exists(spark, above) and not is_folder(spark, above):
        found.append(f"StorageNotAFolder:{above}")
    return found


class ConfigurationStore:
    def __init__(self, path: str):
        self.path = path

    def configure(self, candidate: Configuration) -> Configuration:
        if found := issues(candidate):
            raise InvalidRequest(", ".join(found))
        folder = os.path.dirname(self.path) or "."
        with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as out:
            json.dump(asdict(candidate), out)
        os.replace(out.name, self.path)
        return candidate

    def observe(self) -> Configuration:
        """The active configuration. What a file of an older version lacks has its default; one that can't be read as a configuration makes none active."""
        try:
            with open(self.path) as f:
                x = json.load(f)
            roots = tuple(Root(r["path"], r["source"], r["identifier"], Limits(**r.get("limits", {}))) for r in x["roots"])
            return Configuration(roots, tuple(x.get("repositories", ())), x.get("archive"), InterfaceLimits(**x.get("limits", {})))
        except FileNotFoundError as e:
            raise ConfigurationUnavailable(self.path) from e
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise ConfigurationUnavailable(f"{self.path} isn't a configuration: {e}") from e


#: Folders below a home directory where the producers keep transcripts, by source.
DEFAULT_FOLDERS = {"Claude": ".claude/projects", "Codex": ".codex/sessions", "Pi": ".pi/agent/sessions"}


def default_roots(home: str, workspace: str) -> list[Root]:
    """Roots of one workspace: tools that keep a folder a workspace name it by its path with every character but letters and digits as a dash."""
    name = "".join(c if c.isalnum() else "-" for c in workspace)
    paths = {"Claude": f"{DEFAULT_FOLDERS['Claude']}/{name}", "Codex": DEFAULT_FOLDERS["Codex"], "Pi": f"{DEFAULT_FOLDERS['Pi']}/{name}"}
    return [Root(f"{home.rstrip('/')}/{p}", s, f"{s.lower()}-default") for s, p in paths.items()]
