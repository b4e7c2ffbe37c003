"""Call graph lookups of files with many neighbours."""

from codeloom.engine import Repository


def test_callers_behind_many_dependents(make_files):
    texts = {"lib.py": "def target():\n    return 1\n\n\ndef other():\n    return 2\n"}
    texts |= {f"a{i:03}.py": f"from lib import other\n\n\ndef f{i}():\n    return other()\n" for i in range(55)}
    texts["z.py"] = "from lib import target\n\n\ndef last():\n    return target()\n"
    found = Repository(make_files(texts)).callers("lib.py", "target").collect()
    assert len(found) == 1 and "last" in str(found[0])
