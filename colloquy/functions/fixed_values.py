"""Fixed values. They decide results, so they are stated once, here, as plain text."""

# ---- markers ----------------------------------------------------------------
DIALOG_SEP = "<|endofdialog|>"
CHAT, END, READ = "<|chat|>", "<|end|>", "<|read|>"
ROUTE, DEST = "<|route|>", "<|dest|>"
CODE, CLS, IMG = "<|code|>", "<|cls|>", "<|img|>"
REASON, THINK, ANSWER = "<|reason|>", "<|think|>", "<|answer|>"

# ---- limits -----------------------------------------------------------------
MAX_UTTERANCE_CHARS = 320
MAX_MESSAGE_CHARS = 400
MAX_REPLY_CHARS = 200
HISTORY_LINES = 8
NUM_CANDIDATES = 12
MMI_LAMBDA = 0.7
MIN_CONF = 0.6
SNIPPET_CHARS = (16, 800)
DESC_CHARS = (20, 120)
QUESTION_CHARS = (12, 400)
MAX_Q_CHARS = 600
MIN_THINK_CHARS = 40
MAX_ANSWER_CHARS = 120
MAX_DOC_CHARS = 1200
MAX_FILE_BYTES = 250_000
MAX_ATTACHMENT_BYTES = 8 * 1024 * 1024
MAX_LINE_CHARS = 400
MAX_MEAN_LINE_CHARS = 120
MAX_SHORT_IDENT_SHARE = 0.5
REASON_HOLDOUT = 40
ROUTE_HOLDOUT = 6
READER_LEN = 160
DISCORD_LIMIT = 2000
GOOGLE_CHAT_LIMIT = 4096
MESSAGE_MARGIN = 8
LEAST_MESSAGE = 16
GRID_WIDTH = (3, 80)
GRID_ALPHABET = 20
MONOSPACE = r"(?m)[█▲●·■▓▒░│─┌┐└┘├┤┬┴┼]|^[ \t]{2,}\S|\S {2,}\S"
BUDGETS_MS = [("30 fps", 33.33), ("60 fps", 16.67), ("120 fps", 8.33)]
HOLDOUT_SCORES = [17, 33, 54, 76, 91]

# ---- labels and caps --------------------------------------------------------
ROUTES = ["chat", "reason", "codegen", "code", "vision", "game"]
ROUTE_CAPS = {"chat": 15_000, "reason": 10_000, "codegen": 8_000,
              "code": 2_500, "vision": 2_500, "game": 2_500}

# ---- regular expressions (Java syntax) --------------------------------------
# Whitespace as Python's str methods see it.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NON_WS = r"[^\s\x1c-\x1f\x85\p{Z}]"
HANDLE = r"(?i)\d{1,2}-\d{1,2}-(?:teens|adults|\d{1,3}s(?:\d+)?)User\d+"
CALC_NOTE = r"<<[^>]*>>"
NUMBER = r"-?\d+(?:\.\d+)?"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
ANSWER_MARK = (r"(?:the\s+(?:final\s+)?answer\s+is\s*:?|final\s+answer\s*:?"
               r"|answer\s+is\s*:?|answer\s*:|####)")
TRAILING_VALUE = r"([-+]?\$?\d[\d,]*(?:\.\d+)?\s*%?|\\boxed\{[^{}]*\})\s*[.!]?$"
CHOICES = r"(?i)\b(?:answer\s+choices|options)\b\s*:?"
SENTENCE = r"[^.!?]+[.!?]+(?:['\")\]]+)?"
# The same sentence in possessive form, for anchored use.
SENTENCE_ONCE = r"[^.!?]++[.!?]++(?:['\")\]]++)?"
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TASK_LEAD = r"(?i)^\s*write a (python )?(function|program|script)\s+(to|that|which)\s+"
DOC_NOISE = r"(?i):param|@param|>>>|--|\.\.\.|http|\bTODO\b|[`<>|\\]|\+\S+\+"
CONFLICT = (r"\bwhat (programming )?language\b"
            r"|\b(write|generate|code) (me )?(a|an|some)?\s?\w*\s?"
            r"(function|script|program|code|snippet)\b"
            r"|\bin the (image|picture|photo|screenshot)\b"
            r"|\bwhat'?s? the score\b|\bhow long is the snake\b"
            r"|\bwhere'?s? the (food|apple)\b")
QUANTITY = (r"\bhow (many|much)\b"
            r"|\bwhat'?s? the (total|sum|average|difference|product)\b")
BLOCKLIST = (r"\b(?:fuck\w*|shit\w*|bitch\w*|cunt\w*|nigg\w*|fag\w*|cock\w*|dick\w*"
             r"|pussy|horn(?:y|ie\w*)|sexy?|nude\w*|naked|porn\w*|slut\w*|whore\w*"
             r"|rape\w*|penis|vagina|boob\w*|tit(?:s|ties)?)\b")
MACHINE_FINGERPRINTS = [
    r"_0x[0-9a-f]{3,}",
    r"(\\x[0-9a-fA-F]{2}){3,}",
    r"(\\u[0-9a-fA-F]{4}){3,}",
    r"\+!\+\[\]|\[\]\[\(!\[\]",
    r"\beval\s*\(\s*(function|atob|unescape|String\.fromCharCode)",
    r"String\.fromCharCode\(\s*(?:0x[0-9a-f]+|\d+)\s*(?:,\s*(?:0x[0-9a-f]+|\d+)\s*){4,}\)",
    r"_WEBPACK_IMPORTED_MODULE|__webpack_",
    r"_interopRequireDefault|\b_\w+2\.default\b",
    r"\b_(classCallCheck|createClass|possibleConstructorReturn|slicedToArray"
    r"|toConsumableArray|objectSpread|inherits)\b",
]
IDENTIFIER = r"\b[A-Za-z_$][A-Za-z0-9_$]*\b"
ASK_VERB = r"(write|generate|create|implement|make|code up|build|give me|show me|need|want)"
ASK_NOUN = (r"(function|method|def|class|program|script|snippet|code|algorithm|routine"
            r"|one[- ]?liner)")
ASK_LANG = r"(python|py|javascript|js|node|typescript|ts|java|c\+\+|cpp|golang|go|ruby|php)"
REASON_VERB = (r"(solve|calculate|compute|work out|figure out|reason|think through|think step"
               r"|step by step|explain why|prove)")
REASON_ASK = (r"(how (many|much|long|old|far|fast)|what('s| is|s) the "
              r"(total|sum|difference|product|average|mean|answer|result|percentage|remainder))")
IMAGE_WORD = r"\b(images?|pictures?|photos?|pics?|screenshots?)\b"
CODE_WORD = r"\b(language|lang|code|file|snippet|written in|in)\b"
ASKING_WORD = r"\b(what|which|tell|guess|know|recognize|see|saw|seen|think)\b"

# ---- word lists -------------------------------------------------------------
CODE_KEYWORDS = (
    "var let const function return if else for while new this typeof in of class "
    "extends super null true false undefined try catch throw switch case break "
    "continue do delete void instanceof yield await async static get set import "
    "export from default require module exports def self end elsif nil puts func "
    "package type struct interface map range go defer chan public private static "
    "int void string bool echo").split()
NOT_A_VERB = ("this its his hers less class pass cross press access "
              "address gas news series status always plus").split()

# ---- languages and files ----------------------------------------------------
COMMENT_MARK = {"python": "#", "ruby": "#", "javascript": "//", "typescript": "//",
                "java": "//", "php": "//", "go": "//", "c": "//", "cpp": "//"}
EXT_LANGUAGE = {"py": "python", "js": "javascript", "mjs": "javascript",
                "jsx": "javascript", "ts": "typescript", "go": "go",
                "rb": "ruby", "php": "php", "java": "java"}
MINIFIED_EXTS = ["js", "mjs", "jsx", "ts"]
MINIFIED_LANGS = ["javascript", "typescript"]
SKIP_DIRS = ["node_modules", ".git", "build", "dist", "out", "__pycache__",
             ".venv", "coverage", ".cache", "vendor", "min", "resources"]
IMAGE_EXTS = ["png", "jpg", "jpeg", "gif", "bmp", "webp"]
CODE_EXTS = ["py", "js", "ts", "java", "c", "h", "cpp", "cc", "hpp",
             "go", "rb", "php", "rs", "sh", "swift", "kt"]
# Order matters: the first keyword found names the language.
LANGUAGE_KEYWORDS = [
    ("python", "python"), (" py ", "python"), ("typescript", "typescript"),
    (" ts ", "typescript"), ("javascript", "javascript"), (" js ", "javascript"),
    ("node", "javascript"), ("c++", "cpp"), (" cpp ", "cpp"), ("java", "java"),
    ("golang", "go"), (" go ", "go"), ("ruby", "ruby"), ("php", "php"), (" c ", "c")]
COMMANDS = {"play": "play", "duel": "duel", "versus": "duel", "vs": "duel", "stop": "stop",
            "score": "score", "state": "state", "status": "state", "board": "board",
            "games": "games", "see": "see", "recognize": "see", "code": "code",
            "lang": "code", "gen": "gen", "generate": "gen", "think": "think",
            "reason": "think", "solve": "think", "route": "route", "routing": "route",
            "model": "model", "info": "model", "goal": "goal", "stats": "stats",
            "help": "help"}

# ---- state reader -----------------------------------------------------------
READER_CHARS = "\n |:.,'0123456789abcdefghijklmnopqrstuvwxyz"
DIRECTIONS = ["up", "down", "left", "right", "up and left", "up and right",
              "down and left", "down and right"]
QUESTIONS = {
    "score": ["whats the score", "what's the score", "score", "how many points",
              "how am i doing", "am i winning", "what's my score", "how many points do i have"],
    "length": ["how long am i", "how long is the snake", "what's my length",
               "how big am i", "how long"],
    "food": ["where is the food", "where's the food", "where's the apple",
             "which way to the food", "where do i go"],
    "over": ["is it over", "is the game over", "are we done", "still going",
             "is it finished", "did it end"],
    "turn": ["whose turn is it", "whose turn", "is it my turn", "whose move"],
}
# {v} is the value read.
ANSWER_FORMS = {
    "score": ["the score is {v}", "you have {v} points", "score is {v}", "it's {v}"],
    "length": ["you're {v} long", "length is {v}", "{v} segments"],
    "food": ["the food is {v}", "food is {v}", "it's {v}"],
    "turn": ["it's {v}'s turn"],
}
OVER_ANSWERS = {"yes": "yes, it's over", "no": "no, still going"}
SMALL_TALK = [
    "hi", "hey", "hello", "how are you", "nice", "nice moves", "good job",
    "cool", "lol", "haha", "thanks", "thank you", "you're great", "wow",
    "what should i eat", "tell me a joke", "what's the weather", "i'm bored",
    "do you like music", "that's funny", "interesting", "ok", "sure", "yeah",
    "what's your name", "how old are you", "keep it up", "you can do it",
    "what's up", "good morning", "see you later", "amazing", "hmm", "really",
]

# ---- phrasings of synthesized messages --------------------------------------
FILLERS = ["hey ", "hi ", "so ", "ok ", "um ", "quick question, ", "wait ",
           "btw ", "hey, ", "also ", "one more thing, ", "sorry, ", "and "]
TAILS = [" please", " thanks", " again", " for me", " if you can", " btw"]
ENDINGS = ["?", "?", "?", ".", "", "", "!"]
VISION_TEMPLATES = [
    "what's in the {pic}", "what is in the {pic}", "what did you see in the {pic}",
    "what was that {pic}", "what does the {pic} show", "can you tell what the {pic} is",
    "describe the {pic}", "what was the {pic} again", "did you recognize the {pic}",
    "tell me what the {pic} was", "what do you think that {pic} is",
    "how sure are you about the {pic}", "what did the {pic} look like to you",
    "was the {pic} a dog", "what number was in the {pic}", "what did you make of the {pic}",
    "you saw the {pic} right, what was it", "identify the {pic}",
]
VISION_SLOTS = {"pic": ["image", "picture", "photo", "pic", "screenshot", "photograph",
                        "png", "jpg", "snapshot", "drawing"]}
CODE_TEMPLATES = [
    "what language is {it}", "what language was {it} written in",
    "what programming language is {it}", "can you tell what language {it} is",
    "which language is {it}", "do you know what language {it} is in",
    "what kind of code is {it}", "was {it} python", "what language was {it} again",
    "tell me what language {it} is", "how sure are you about {it}",
    "what did you think {it} was written in", "is {it} javascript",
    "what language did you say {it} was", "name the language of {it}",
]
CODE_SLOTS = {"it": ["that", "this", "that file", "the file", "that snippet", "the snippet",
                     "that code", "the code", "it", "the source file", "my file"]}
GAME_TEMPLATES = [
    "what's my {stat}", "what is the {stat} right now", "how's the {stat}",
    "tell me the {stat}", "what's the {stat} now", "can you tell me the {stat}",
    "any idea what the {stat} is", "give me the {stat}",
    "where is the {thing}", "which way to the {thing}", "how far is the {thing}",
    "where do i find the {thing}", "can you see the {thing}", "how close am i to the {thing}",
    "is the {noun} over", "are we still {verb}ing", "did the {noun} end",
    "how's the {noun} going", "are you still {verb}ing", "did you lose the {noun}",
]
GAME_SLOTS = {
    "stat": ["score", "length", "high score", "snake length", "current score", "board", "state"],
    "thing": ["food", "apple", "ball", "target", "block", "wall"],
    "noun": ["game", "round", "match"], "verb": ["play", "go"]}
ARITHMETIC_TEMPLATES = [
    "what's {a} times {b}", "what is {a} plus {b}", "how much is {a} minus {b}",
    "{a} divided by {b} is what", "what's {p}% of {a}", "how many is {a} times {b}",
    "what's the total of {a} and {b}", "add up {a}, {b} and {c}",
    "what do i get if i take {b} away from {a}",
    "if i split {a} between {b} people how much does each get",
    "how many {b}s go into {a}", "{a} plus {b} equals",
    "work out {a} times {b} minus {c}", "whats {p} percent of {a}",
]
PERCENTS = [5, 10, 15, 20, 25, 30, 40, 60, 75, 90]
REQUEST_LANGS = ["python", "py", "javascript", "js", "java", "go", "ruby", "php",
                 "typescript", "c++", "node", "bash"]
ASK_TO = [
    "write me a function to {desc}", "generate a {lang} function to {desc}",
    "make a {lang} function to {desc}", "write a script to {desc}",
    "show me {lang} code to {desc}", "how do i {desc} in {lang}",
    "what's the best way to {desc} in {lang}", "i need {lang} code to {desc}",
    "write the {lang} to {desc}",
]
ASK_THAT = [
    "write a {lang} function that {desc}", "can you write {lang} code that {desc}",
    "i need a {lang} function that {desc}", "give me a {lang} snippet that {desc}",
    "code up something that {desc}", "a {lang} function that {desc}",
    "could you write a function that {desc}", "write a script that {desc}",
]
CANNED_LINES = ["you there? say something :)", "hmm? type something and i'll bite",
                "ok... use your words"]

# ---- source mix: (name, renderer, licence, cap, scan, weight) ---------------
SOURCE_MIX = [
    ("openmathinstruct", "expected_answer", "CC-BY-4.0", 900_000, 1_500_000, 8),
    ("gsm8k_main", "hash_marks", "MIT", 8_000, 10_000, 1),
    ("gsm8k_socratic", "hash_marks", "MIT", 8_000, 10_000, 1),
    ("metamath", "rephrased", "MIT", 395_000, 400_000, 3),
    ("mathinstruct", "cot_only", "MIT", 262_000, 300_000, 2),
    ("orca_math", "qa", "MIT", 200_000, 200_000, 3),
    ("numina", "qa", "Apache-2.0", 300_000, 500_000, 3),
    ("aqua_rat", "options", "Apache-2.0", 97_000, 100_000, 2),
    ("strategyqa", "yes_no", "MIT", 3_000, 5_000, 1),
]

# ---- pictures as glyphs -----------------------------------------------------
MAX_SIDE = 16
GLYPHS = ".:+#"
HUES = "rygcbm"
CHROMA_MIN = 48.0

# ---- hand-written probe messages --------------------------------------------
PROBE = [
    ("hey, how's your day going", "chat"),
    ("i just got back from the gym and i'm wrecked", "chat"),
    ("do you like pineapple on pizza", "chat"),
    ("that's hilarious lol", "chat"),
    ("i'm so tired today", "chat"),
    ("what's your name again", "chat"),
    ("tell me something interesting", "chat"),
    ("good morning!", "chat"),
    ("ok cool, talk to you later", "chat"),
    ("my sister is getting married in june", "chat"),
    ("do you ever get bored", "chat"),
    ("nah i don't think so", "chat"),
    ("what kind of music do you like", "chat"),
    ("it's been raining all week here", "chat"),
    ("if a train leaves at 3pm doing 60 mph, how far has it gone by 5:30", "reason"),
    ("i bought 3 shirts at $12 each and paid with a fifty, what's my change", "reason"),
    ("there are 24 kids and 4 buses, how many kids per bus", "reason"),
    ("work out how many minutes there are in a fortnight", "reason"),
    ("a pizza is cut into 8 slices and i ate 3, what fraction is left", "reason"),
    ("solve this: 4x + 7 = 31", "reason"),
    ("if it takes 5 machines 5 minutes to make 5 widgets, how long for 100", "reason"),
    ("figure out the average of 12, 19 and 44", "reason"),
    ("write me a python function to reverse a linked list", "codegen"),
    ("can you code up a debounce helper in js", "codegen"),
    ("i need a script that renames files by their date", "codegen"),
    ("show me a go function that reads a csv", "codegen"),
    ("quick python snippet to flatten a nested list", "codegen"),
    ("build me a class that wraps an http client with retries", "codegen"),
    ("write something in ruby to strip html tags", "codegen"),
    ("how would you implement binary search in java", "codegen"),
    ("what language was that file", "code"),
    ("so what is it written in", "code"),
    ("you sure that's ruby", "code"),
    ("which language did you say it was", "code"),
    ("was the thing i just sent you go or rust", "code"),
    ("remind me what you decided about my script", "code"),
    ("what was in that picture again", "vision"),
    ("so what did you see", "vision"),
    ("how confident were you about that photo", "vision"),
    ("was it a cat or a dog in the pic", "vision"),
    ("did you get the digit right", "vision"),
    ("tell me again what the image showed", "vision"),
    ("what's the score at", "game"),
    ("how long is my snake now", "game"),
    ("which way should i go for the food", "game"),
    ("are we done yet", "game"),
    ("am i winning", "game"),
    ("is the round finished", "game"),
]
