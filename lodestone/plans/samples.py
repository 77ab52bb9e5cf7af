"""Literal inputs for operators no table carries data for; of our own making."""

import json

VECTORS = [
    ("identical", [1.0, 2.0, 2.0], [1.0, 2.0, 2.0]),
    ("doubled", [1.0, 2.0, 2.0], [2.0, 4.0, 4.0]),
    ("orthogonal", [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]),
    ("opposite", [1.0, 2.0, 2.0], [-1.0, -2.0, -2.0]),
]
IDENTIFIERS = ["parseHTTPResponse p5Vector", "p5 2.3.2 #9030", "snake_case_name and camelCase", "URL parseURL", "plain words twice words", "a1B2 ABCdef __init__", ""]
TITLES = ["  Fix the  Bug!! ", "Fix the bug .", "fix THE bug", "What? No...", "", "a\tb", "Version 2.0"]
PATHS = ["src/core/main.js", "README.MD", "docs/.md", "docs/guide.md", "package-lock.json", "a/package-lock.json", "translations/es/translation.json", "translations/es/x.json", "test/unit/visual/screenshots/a/000.json", "src/a.test.ts", "Makefile", "lib/.all-contributorsrc", "x.tar.lock"]


def _file(path: str, *hunks: str, old: str | None = None) -> str:
    return f"diff --git a/{old or path} b/{path}\nindex 1..2 100644\n--- a/{old or path}\n+++ b/{path}\n" + "".join(hunks)


ONE = "@@ -1,3 +1,4 @@ def run():\n a\n+b\n c\n"
BARE = "@@ -5 +6 @@\n-x\n+y\n"
DIFFS = [
    (1, _file("lib/util.py", ONE)),
    (2, _file("lib/util.py", ONE, BARE, "@@ -9,2 +9,1 @@ class A:\n-gone\n-gone too\n") + _file("docs/guide.md", ONE)),
    (3, _file("lib/marker.py", "@@ -1,2 +1,3 @@\n a\n+@@ -1,3 +1,3 @@\n b\n")),
    (4, "diff --git a/x.py b/x.py\ndeleted file mode 100644\n--- a/x.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n"),
    (5, "diff --git a/a.py b/b.py\nsimilarity index 100%\nrename from a.py\nrename to b.py\n"),
    (6, ""),
    (7, "diff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n" + _file("ci/a.yml", ONE)),
    (8, _file("docs/only.md", ONE).rstrip("\n")),
    (9, _file("src/my file.js", "@@ -1 +1 @@\n-a\n+b\n\\ No newline at end of file\n").replace("+++ b/src/my file.js", "+++ b/src/my file.js\t")),
    (10, "preamble\n" + _file("src/z.ts", BARE) + _file("src/a.ts", ONE)),
]
UNAVAILABLE = [11]
VERDICTS = [(1, None), (2, None), (3, "bot_author"), (4, None), (7, None), (8, None), (11, None), (10, "housekeeping")]


def _item(number: int, **more) -> str:
    base = {"number": number, "id": 1000 + number, "title": f"Change {number}", "body": None, "user": {"login": f"dev{number}", "type": "User"}, "state": "closed", "created_at": f"2024-03-{number:02d}T09:00:00Z", "merged_at": None, "closed_at": "2024-04-01T00:00:00Z", "labels": [], "head": {"sha": f"s{number}"}, "base": {"repo": {"id": 1}}}
    return json.dumps(base | more)


ITEMS = [
    _item(1, merged_at="2024-03-02T00:00:00Z", labels=[{"name": "bug"}, {"name": "Area: core"}]),
    _item(2, state="open", closed_at=None),
    _item(3, user={"login": "robot", "type": "Bot"}),
    _item(4, user=None),
    _item(7, user={"login": None, "type": None}),
    _item(8, body="text"),
    _item(10),
    _item(11, user={"login": "", "type": "User"}),
]
