"""The composed scans on a miniature app."""

from corpusloom.plans import scans

FILES = {
    "src/tokens.ts": "export const colors = {\n  primary: '#0000ff',\n};\n",
    "src/components/Card.tsx": "import { colors } from '../tokens';\nconst s = { color: colors.primary, padding: 13, borderRadius: 8, fontFamily: 'Inter' };",
    "src/screens/Home.tsx": "import Card from '../components/Card';\nconst s = { color: '#ff0000', tint: '#fe0000', padding: 16, x: colors.primary };",
    "src/screens/Info.tsx": "import Card from '../components/Card';\nconst s = { margin: 24 };",
}


def corpus(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, text string")


def test_migration(spark):
    got = scans.migration(corpus(spark))
    assert sorted((r.path, r.role) for r in got["scope"].collect()) == [("src/components/Card.tsx", "component"), ("src/screens/Home.tsx", "screen"), ("src/screens/Info.tsx", "screen"), ("src/tokens.ts", "component")]
    phases = {r.node: r.phase for r in got["phases"].collect()}
    assert phases["src/tokens.ts"] < phases["src/components/Card.tsx"] < phases["src/screens/Home.tsx"] == phases["src/screens/Info.tsx"]
    s = got["summary"].first()
    assert (s.files, s.tokens, s.cycles, s.readiness, s.complexity) == (4, 1, 0, "ready", "low")
    assert [r.phase for r in got["cluster_phases"].collect()] == [phases["src/components/Card.tsx"]]


def test_rebrand(spark):
    got = scans.rebrand(corpus(spark))
    f = got["fingerprint"].first()
    assert (f.colors, f.duplicate_colors, f.custom_fonts, f.corners) == (2, 1, 1, "soft") and f.temperature == "warm" and "2 colors" in f.paragraph
    s = got["summary"].first()
    assert (s.readiness, s.violation_verdict) == ("coherent-enough", "moderate")


def test_empty(spark):
    none = corpus(spark).limit(0)
    assert scans.rebrand(none)["summary"].first().readiness == "coherent-enough"
    assert scans.migration(none)["summary"].first().files == 0
    assert scans.extraction(none)["summary"].first().candidates == 0
    got = scans.breaking(none, "src")["summary"].first()
    assert (got.files, got.has_token_module, got.approach, got.target_resolved) == (0, False, "unknown", False)


def test_breaking(spark):
    got = scans.breaking(corpus(spark), "src/screens")
    assert [(r.token, r.hits, r.other_files, r["sample"]) for r in got["blast"].collect()] == [("colors.primary", 2, 1, ["src/components/Card.tsx"])]
    s = got["summary"].first()
    assert (s.files, s.has_token_module, s.target_resolved) == (4, True, True) and "Few other files" in s.note
    assert "No target" in scans.breaking(corpus(spark))["summary"].first().note


def test_breaking_counts_uses_in_longer_references(spark):
    files = [("a.ts", "x = colors.primary.main"), ("b.ts", "y = theme.colors.primary"), ("c.ts", "z = theme.colors")]
    got = scans.breaking(spark.createDataFrame(files, "path string, text string"), "a.ts")
    assert [(r.token, r.hits, r["sample"]) for r in got["blast"].collect()] == [("colors.primary", 2, ["b.ts"])]


def test_rethinking(spark):
    screen = "import { Card } from './Card';\nimport { Card as C } from 'x';\n<View><Title/><Card/><Row style={s.a}/><Row style={s.a}/></View>"
    files = [("src/Card/index.tsx", "export const Card = 1"), ("src/Home.tsx", screen), ("src/Other.tsx", "<Card/>")]
    got = scans.rethinking(spark.createDataFrame(files, "path string, text string"), "src/Card/index.tsx")
    assert [tuple(r) for r in got["sites"].collect()] == [("src/Home.tsx", 1, "./Card")]
    assert [(r.before, r.after) for r in got["neighbors"].collect()] == [(["View", "Title"], ["Row", "Row"])]
    assert [(r.tag, r.n, r["rank"]) for r in got["siblings"].orderBy("rank").collect()] == [("Row", 2, 1), ("Title", 1, 2)]
    assert [(r.ref, r.n) for r in got["reused"].collect()] == [("s.a", 2)]
    s = got["summary"].first()
    assert (s.component, s.usages, s.has_token_module) == ("Card", 1, False) and "1 files use Card" in s.note


def test_flow(spark):
    files = [("app/_layout.tsx", "<Stack />"), ("app/index.tsx", "router.push('/info')"), ("app/info.tsx", "")]
    got = scans.flow(spark.createDataFrame(files, "path string, text string"), "expo-router")
    s = got["summary"].first()
    assert (s.router, s.screens, s.navigators, s.transitions, s.links) == ("expo-router", 2, 1, 1, 1) and "2 screens" in s.note
    assert [r.to for r in got["transitions"].collect()] == ["info"]
    made = [("nav.tsx", "const S = createNativeStackNavigator();\n<NavigationContainer><S.Screen name=\"Home\" /></NavigationContainer>; navigation.navigate('Home')")]
    s = scans.flow(spark.createDataFrame(made, "path string, text string"), "react-navigation")["summary"].first()
    assert (s.screens, s.navigators, s.transitions) == (1, 1, 1)
    assert scans.flow(spark.createDataFrame(made, "path string, text string"), "other")["summary"].first().router == "unknown"


def test_extraction(spark):
    code = "a: '#FFF', b: '#fff', c: '#fff', padding: 16, margin: 16, duration: 300"
    got = scans.extraction(spark.createDataFrame([("a.ts", code), ("b.ts", None)], "path string, text string"), 2)
    assert [(r.value, r.n) for r in got["colors"].collect()] == [("#fff", 3)] and [(r.value, r.n) for r in got["sizes"].collect()] == [("16.0", 2)]
    s = got["summary"].first()
    assert (s.files, s.literals, s.colors, s.durations, s.candidates) == (2, 6, 1, 0, 2)
