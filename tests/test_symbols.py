"""The lexer against hand-made files, and the sweep for the innermost range against brute force."""

import random
import textwrap

import pytest

from skeinworks.operators import code, symbols

FILES = {
    "multi-line heads, strings and comments": (
        '''
        static inline const std::map<int, std::vector<int>>&
        lookup(int a, /* { */
               const char* s = "}{",
               char c = '{') // }
        {
            if (a) { return "}"; }
            return 'x';
        }
        int tail() { return 0; }
        ''',
        [("lookup", "function", 2, 8, "", ""), ("tail", "function", 9, 9, "", "")],
    ),
    "nested scopes": (
        '''
        namespace a { namespace b::c {
        template <class T, class U = std::less<T>>
        class Box final : public Base<T>, private Other
        {
        public:
            explicit Box(int n) : n_(n), list_{1, 2} { go(); }
            ~Box();
            bool operator==(const Box& o) const = default;
            operator bool() const { return true; }
            struct Part { int x; } part_;
            enum class Kind : char { A, B = 2 };
            typedef int number;
            void (*call)(int);
        private:
            int n_;
        };
        }
        void free_() {}
        }
        int outside;
        ''',
        [
            ("Box", "class", 3, 16, "a::b::c", "namespace"), ("Box", "function", 6, 6, "a::b::c::Box", "class"), ("~Box", "prototype", 7, 7, "a::b::c::Box", "class"), ("operator ==", "prototype", 8, 8, "a::b::c::Box", "class"),
            ("operator bool", "function", 9, 9, "a::b::c::Box", "class"), ("Part", "struct", 10, 10, "a::b::c::Box", "class"), ("Kind", "enum", 11, 11, "a::b::c::Box", "class"), ("number", "typedef", 12, 12, "a::b::c::Box", "class"),
            ("free_", "function", 18, 18, "a", "namespace"),
        ],
    ),
    "methods outside of their class": (
        '''
        template <> int Box<int>::size() const noexcept { return 1; }
        Box::Box() try : n_(1) { } catch (...) { }
        Outer::Inner::~Inner() { while (1) { } }
        auto Box::begin() -> Iterator { return x; }
        void Box::operator()(int a) { }
        ''',
        [("size", "function", 1, 1, "Box", "class"), ("Box", "function", 2, 2, "Box", "class"), ("~Inner", "function", 3, 3, "Outer::Inner", "class"), ("begin", "function", 4, 4, "Box", "class"), ("operator ()", "function", 5, 5, "Box", "class")],
    ),
    "directives": (
        '''
        #define ONE 1 // {
        #define MANY(a) do { \\\\
            a; \\\\
        } while (0)
        #if 0
        void dead() {
        #elif defined(X)
        void live() {
        #else
        void other() {
        #endif
        }
        #ifdef A
        int a() { return 1; }
        #else
        int b() { return 1; }
        #endif
          # define INDENTED
        ''',
        [("ONE", "macro", 1, 1, "", ""), ("MANY", "macro", 2, 4, "", ""), ("live", "function", 8, 12, "", ""), ("a", "function", 14, 14, "", ""), ("INDENTED", "macro", 18, 18, "", "")],
    ),
    "what isn't a definition": (
        '''
        using namespace std;
        class Later;
        friend class F;
        int table[] = { 1, 2 };
        static const Point origin{0, 0};
        int x(5);
        const char* raw = R"x(
        void no() { )" }
        )x";
        auto f = [](int a) { return a; };
        extern int variable;
        CALL(a, b);
        ''',
        [],
    ),
    "typedefs and prototypes": (
        '''
        typedef struct { int a; } Plain;
        typedef struct Named_ { int a; } Named;
        typedef void (*Call)(int);
        typedef int Row[4];
        using Vec = std::vector<int>;
        extern "C" { int c_call(void); }
        virtual int later(
            int a,
            int b) = 0;
        ''',
        [
            ("Named_", "struct", 2, 2, "", ""), ("Named", "typedef", 2, 2, "", ""), ("Plain", "typedef", 1, 1, "", ""), ("Call", "typedef", 3, 3, "", ""), ("Row", "typedef", 4, 4, "", ""), ("Vec", "typedef", 5, 5, "", ""),
            ("c_call", "prototype", 6, 6, "", ""), ("later", "prototype", 7, 9, "", ""),
        ],
    ),
    "unfinished": ("void open_() {\n  {\n", [("open_", "function", 1, 2, "", "")]),
    "stray braces": ("}\n}\nint f() { return 1; }\n};\nint g() { return 2; }", [("f", "function", 3, 3, "", ""), ("g", "function", 5, 5, "", "")]),
    "line ends": ("int a()\r\n{\r\n}\r\nint b() { }\r\n", [("a", "function", 1, 3, "", ""), ("b", "function", 4, 4, "", "")]),
}


@pytest.mark.parametrize("name", FILES)
def test_definitions(name):
    text, want = FILES[name]
    text = textwrap.dedent(text).lstrip("\n").replace("\\\\", "\\")
    assert sorted(symbols.symbols_of(text)) == sorted(want)


def test_a_long_file_takes_linear_time():
    import time

    piece = "class C {\n  int f(int a) { if (a) { return 1; } return 0; }\n};\nint g(int a);\n"
    symbols.symbols_of(piece * 10)
    took = []
    for n in (500, 4000):
        began = time.perf_counter()
        assert len(symbols.symbols_of(piece * n)) == 3 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0]


def test_files_without_symbols(spark):
    f = spark.createDataFrame([("a", None), ("b", ""), ("c", "int x;")], "file string, text string")
    assert symbols.symbols(f).count() == 0
    assert symbols.symbols(f.limit(0)).count() == 0


def test_innermost_range(spark):
    r = random.Random(3)
    ranges, at = [], 0

    def nest(file, lo, hi, depth):
        while lo < hi and r.random() < 0.9:
            a = r.randint(lo, hi)
            b = r.randint(a, min(hi, a + r.choice([0, 1, 5, 60])))
            ranges.append((file, a, b, f"r{len(ranges)}"))
            if depth:
                nest(file, a + 1, b - 1, depth - 1)
            lo = b + 1

    for file in ("x", "y"):
        nest(file, 1, 400, 4)
    ranges.append(("x", 1, 2000, "all"))
    probes = [(f, line, i) for i, (f, line) in enumerate((f, line) for f in ("x", "y", "z") for line in range(0, 420))]
    probes.append(("x", 1999, -1))
    p, q = spark.createDataFrame(probes, "file string, line long, id long"), spark.createDataFrame(ranges, "file string, start long, end long, name string")
    for step in (7, 256):
        got = {x["id"]: x["inner"] and x["inner"]["name"] for x in symbols.enclosing(p, q, step).collect()}
        for f, line, i in probes:
            around = [(b - a, -a, n) for g, a, b, n in ranges if g == f and a <= line <= b]
            assert got[i] == (min(around)[2] if around else None), (f, line)


def test_handlers(spark):
    ends = spark.createDataFrame([("a.cpp", "run", "function", "P", 3, 9), ("a.cpp", "P", "class", "", 1, 20), ("a.cpp", "go", "function", "", 11, 12)], "file string, name string, kind string, class string, line long, end long")
    e = spark.createDataFrame([("a.cpp", 5, "G1"), ("a.cpp", 12, "G2"), ("a.cpp", 15, "G3"), ("b.cpp", 5, "G4")], "file string, line long, command string")
    assert {x["command"]: x["handler"] for x in code.handlers(e, ends).collect()} == {"G1": "P::run", "G2": "go", "G3": "", "G4": ""}
