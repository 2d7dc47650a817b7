"""Settings by space and environment: which spaces opted in, which endpoints are local, which models are vetted."""

from __future__ import annotations

import logging
import os
import tomllib
from pathlib import Path
from urllib.parse import urlsplit

#: Switches of a space with the variable that lists spaces instead; hosts that are this machine.
SWITCHES = {"refuse_identifier_names": "QUILLMESH_REFUSE_IDENTIFIER_NAMES", "strip_name_titles": "QUILLMESH_STRIP_NAME_TITLES"}
LOCAL = ("localhost", "127.0.0.1", "::1")
_log = logging.getLogger(__name__)


def load(path: str | Path) -> dict[str, dict]:
    """{space: settings} of a TOML file's table `spaces`. No file is no settings; neither is one that is malformed or has a switch that is no boolean, which is logged."""
    try:
        spaces = tomllib.loads(Path(path).read_bytes().decode()).get("spaces", {})
        if not isinstance(spaces, dict) or any(not isinstance(t, dict) or any(not isinstance(t[k], bool) for k in SWITCHES if k in t) or not (t.get("file_back", "gate") == "gate" or t.get("file_back") is False) for t in spaces.values()):
            raise ValueError("a space's setting has a wrong kind")
    except FileNotFoundError:
        return {}
    except (OSError, ValueError) as e:
        _log.warning("settings %s ignored: %s", path, e)
        return {}
    return spaces


def spaces_with(switch: str, path: str | Path, env: dict[str, str] | None = None) -> frozenset[str]:
    """The spaces that have a switch on: those its variable lists, else those of the file."""
    listed = frozenset(filter(None, map(str.strip, (os.environ if env is None else env).get(SWITCHES[switch], "").split(","))))
    return listed or frozenset(s for s, t in load(path).items() if t.get(switch) is True)


def file_back(space: str, path: str | Path) -> bool | None:
    """False where a space files no answers, None where the usual gate decides."""
    return False if load(path).get(space, {}).get("file_back") is False else None


def local_endpoint(url: str) -> bool:
    try:
        return urlsplit(url).hostname in LOCAL
    except (ValueError, TypeError, AttributeError):
        return False


def vetted(model: str, prefixes: tuple[str, ...], more: str = "") -> bool:
    """Whether a model's name starts with a vetted prefix, more of them comma-separated."""
    return any(model.startswith(p) for p in (*prefixes, *filter(None, map(str.strip, more.split(",")))))
