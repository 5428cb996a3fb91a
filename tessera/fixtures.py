"""A small corpus of source files for the queries that need declarations, which prose does not have."""

from __future__ import annotations

CODE: tuple[tuple[str, str], ...] = (
    ("src/app.ts", "import { read } from \"./disk\";\nimport './side';\n// start up\nlet started = false, retries = 3;\nconst limits = [1, 2];\n\nexport function boot(plan) {\n  for (const step of plan) {\n    step.run({ retries });\n  }\n}\n\nclass Queue {\n}\n"),
    ("src/api/tide_table.ts", "export class TideTable2 {\n  heightAtUTC(hour: number) {\n    return this.rows[hour % 24] ?? `no ${hour}`;\n  }\n}\nexport default new TideTable2();\n"),
    ("src/comment.ts", "/* header with { (\n still open */\nfunction a() { return 1; }\n/* const hidden = 1;\n*/ const shown = 2;\ninterface Box {\n  width: number;\n}\ntype Id = string;\n"),
    ("src/strings.js", "const s = \"a { b\";\nconst t = 'it\\'s (';\nfunction open() {\n  if (s) {\n    call(\"}\");\n  }\n}\nenum Colour {\n  Red,\n}\n"),
    ("src/export_first.ts", "export { x } from './x';\nconst y = 1;\nexport { y };\nexport const z = 2;\nexport function q(\n  a: number,\n) {\n  return a;\n}\n"),
    ("src/plain.mjs", "start();\n// then wait\nawait finished;\n"),
    ("src/crlf.tsx", "type Size = {\r\n  w: number;\r\n};\r\n\r\nimport './late';\r\n"),
    ("src/clamp.cjs", "}\n)\nconst a = 1;\n{ (\nconst hidden = 1;\n) }\nconst b = 2; /* x */ // {\nclass K {}\n"),
    ("src/long.ts", "function big() {\n" + "".join(f"  line{i}();\n" for i in range(30)) + "}\nlet tail = 1;\n"),
    ("src/empty.ts", ""),
    ("types/react/index.d.ts", "export interface Props {\n  caféName: string;\n}\nexport type HTML5Parser = unknown;\n"),
)

#: Paths for the path filters.
PATHS: tuple[str, ...] = (
    "src/index.ts", "src/INDEX.TS", "src/index.d.ts", "lib/a.js", "lib/b.jsx", "lib/c.mjs", "lib/d.cjs", "README.md",
    "node_modules/pkg/index.js", "packages/x/node_modules/y/z.ts", "dist", "dist/out.js", "build/keep.ts", "assets/logo.svg",
    "assets/logo.PNG", "archive.tar.gz", "archive.tgz", "data.bin", "data.dat", ".tessera/meta", ".tessera/x.ts", ".git/config",
    "package-lock.json", "sub/package-lock.json", "npm-debug.log.1", "a/b/c/deep.ts", "a/x.map", "x.map", "src/a1.ts", "src/b.test.ts",
    "../up.ts", "/abs.ts", "a/../b.ts", "a/..b.ts", "a\\..\\b.ts", "", ".", "noext", "dir.d/noext", "src/.hidden.ts",
)

IGNORE: tuple[str, ...] = ("**/*.svg", ".git/", ".tessera/", "package-lock.json", "node_modules/", "dist/", "build/", "!build/keep.ts", "npm-debug.log*", "**/*.map", "!x.map", "src/[a-c]?.ts")
GLOBS: tuple[str, ...] = ("**/*.ts", "src/*", "*", "**", "a/**/deep.ts", "src/[a-c]*.ts", "src/[^i]*.ts", "src/b\\.test.ts", "lib/?.js*", "[")
