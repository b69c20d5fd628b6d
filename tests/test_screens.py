import pytest

from auditspark.operators import facts, screens, select
from auditspark.sources import tables

FILES = "scan_id string, path string, content binary, read_error string"

BAD_PY = '''
from langgraph.graph import StateGraph
NEEDS = ["langgraph==1.1.0"]
class State(TypedDict):
    session_token: str
def ask(state):
    system_prompt = "Help with " + state["user_input"]
    return chat(system_prompt)
def run_shell(line):
    return eval(line)
def wipe_accounts(name):
    return drop(name)
def forward(state):
    text = state["llm_output"]
    return store(text)
memory = MemorySaver()
app = StateGraph(State).compile(checkpointer=memory)
'''
GOOD_PY = '''
from langgraph.graph import StateGraph
NEEDS = ["langgraph==1.2.0"]
class State(TypedDict):
    question: str
def ask(state):
    system_prompt = "Help with known topics"
    return chat(system_prompt)
def look_up(key):
    return TABLE[key]
def wipe_accounts(name):
    require_admin(name)
    return drop(name)
memory = MemorySaver()
app = StateGraph(State).compile()
'''
BAD_JS = '''
import { StateGraph } from "@langchain/langgraph";
const needs = "@langchain/langgraph@1.1.0";
const State = Annotation.Root({
  apiKey: Annotation({ value: null }),
});
async function ask(state) {
  const prompt = "Help with " + state.userInput;
  return chat(prompt);
}
function runCommand(line) {
  return eval(line);
}
function deleteAccounts(name) {
  return drop(name);
}
function forward(state) {
  const text = state.llmOutput;
  return { content: text };
}
const memory = new MemorySaver();
const app = graph.compile({ checkpointer: memory });
'''
GOOD_JS = '''
import { StateGraph } from "@langchain/langgraph";
const needs = "@langchain/langgraph@1.2.0";
const State = Annotation.Root({
  question: Annotation({ value: null }),
});
async function ask(state) {
  const prompt = "Help with known topics";
  return chat(prompt);
}
function deleteAccounts(name) {
  requireAdmin(name);
  return drop(name);
}
const memory = new MemorySaver();
const app = graph.compile();
'''
# vector -> lines of the planted evidence
PLANTED = {
    "bad.py": {"ASI01": [7], "ASI02": [9, 10], "ASI03": [5], "ASI05": [None], "ASI06": [11], "ASI07": [15], "ASI08": [16]},
    "bad.js": {"ASI01": [8], "ASI02": [11, 12], "ASI03": [5], "ASI05": [None], "ASI06": [14], "ASI07": [19], "ASI08": [21]},
}


@pytest.mark.parametrize("suffix", ["py", "js"])
def test_every_screen_hits_its_plant_and_spares_the_clean_agent(spark, table, suffix):
    bad, good = (BAD_PY, GOOD_PY) if suffix == "py" else (BAD_JS, GOOD_JS)
    files = select.with_suffix(table(
        [("s", f"bad.{suffix}", bad.encode(), None), ("s", f"good.{suffix}", good.encode(), None)], FILES
    ))
    found = screens.all_screens(facts.extract(files), select.with_text(files), tables.advisories(spark))
    made = {}
    for row in found.collect():
        made.setdefault(row["file"], {}).setdefault(row["owasp_id"], []).append(row["line"])
    for vectors in made.values():
        for lines in vectors.values():
            lines.sort(key=lambda line: line or 0)
    assert made == {f"bad.{suffix}": PLANTED[f"bad.{suffix}"]}


def test_each_use_of_model_output_comes_out_once(table):
    source = "reply = llm_output\n" * 5 + "store(reply)\nstore(reply, reply)\nearly(other)\n"
    files = select.with_suffix(table([("s", "a.py", source.encode(), None)], FILES))
    rows = screens.unchecked_output(facts.extract(files)).collect()
    assert sorted(row["line"] for row in rows) == [6, 7]


def _screened(table, screen, source, path="a.py"):
    files = select.with_suffix(table([("s", path, source.encode(), None)], FILES))
    return sorted((row["line"], row["description"].rsplit(": ", 1)[1]) for row in screen(facts.extract(files)).collect())


def test_user_input_over_several_steps(table):
    source = (
        "a = user_input\nb = a\nprompt = b\nb = 'clean'\nprompt = b\nc = f(a.text)\nc.d = c\nprompt_2 = 'Say ' + c.d\n"
        "x = 'a'\nprompt_3 = x\na = 1\nprompt_4 = a\n"
    )
    assert _screened(table, screens.prompt_injection, source) == [(3, "prompt"), (8, "prompt_2")]
    script = "const a = state.userInput;\nlet b = a;\nconst prompt = `Say ${b}`;\nb = 1;\nconst prompt2 = b;\n"
    assert _screened(table, screens.prompt_injection, script, "a.js") == [(3, "prompt")]


def test_evaluation_of_what_a_parameter_reaches(table):
    source = "def f(x, y):\n    z = x\n    eval(z)\n    y = 1\n    eval(y)\neval(other)\ndef g(w): return exec(w)\n"
    assert _screened(table, screens.tool_misuse, source) == [(3, "z"), (7, "w")]


def test_guards_hold_for_their_own_function(table):
    source = (
        "def delete_a(x):\n    require_admin(x)\n    return drop(x)\ndef delete_b(x):\n    return drop(x)\n"
        "@check_permission\ndef delete_c(x):\n    return drop(x)\n"
    )
    assert _screened(table, screens.privilege_escalation, source) == [(4, "delete_b")]
    script = "function deleteA(x) {\n  hasRole(x);\n}\nfunction deleteB(x) {\n  drop(x);\n}\n"
    assert _screened(table, screens.privilege_escalation, script, "a.js") == [(4, "deleteB")]


def test_model_output_over_several_steps(table):
    source = "a = llm_output\nb = a\nstore(b)\nb = 'fixed'\nstore(b)\nc = len(a)\nstore(c)\n"
    assert _screened(table, screens.unchecked_output, source) == [(3, "b"), (6, "a"), (7, "c")]
    script = "const a = state.llmOutput;\nlet b = a;\nsend({ x: b });\nb = 0;\nsend({ x: b });\n"
    assert _screened(table, screens.unchecked_output, script, "a.js") == [(3, "b")]
