"""Build quadra-jts.jar: python -m quadra.jts.build (needs javac; compiles against Spark's own jars)."""

from __future__ import annotations

import subprocess
import tempfile
import zipfile
from pathlib import Path

HERE = Path(__file__).resolve().parent
JAR = HERE / "quadra-jts.jar"


def build(jar: Path = JAR) -> Path:
    import pyspark

    jars = Path(pyspark.__file__).parent / "jars"
    with tempfile.TemporaryDirectory() as out:
        subprocess.run(["javac", "--release", "17", "-nowarn", "-cp", f"{jars}/*", "-d", out, *map(str, sorted((HERE / "src").rglob("*.java")))], check=True)
        with zipfile.ZipFile(jar, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(Path(out).rglob("*.class")):
                z.writestr(zipfile.ZipInfo(str(path.relative_to(out)), (2026, 1, 1, 0, 0, 0)), path.read_bytes())
    return jar


if __name__ == "__main__":
    print(build())
