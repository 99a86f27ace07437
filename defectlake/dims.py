"""Fixed lookup tables. Every operator that uses one also takes it as an argument."""

from __future__ import annotations

import csv
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Enumerations.
# ---------------------------------------------------------------------------------------------
SEVERITIES = ("critical", "high", "medium", "low", "info")
BUG_TYPES = (
    "memory_leak", "use_after_free", "double_free", "buffer_overflow", "buffer_underflow",
    "stack_overflow", "null_deref", "uninit_read", "invalid_free", "heap_corruption",
    "race_condition", "dangling_pointer", "integer_overflow", "format_string",
    "python_reference_cycle", "python_large_object", "rust_unsafe_block", "unknown",
)
TOOLS = (
    "valgrind", "asan", "lsan", "msan", "ubsan", "tsan", "cppcheck", "clang_tidy", "memray",
    "tracemalloc", "rustfmt", "miri", "helgrind", "infer",
)
LANGUAGES = ("c", "cpp", "python", "rust", "unknown")
CONFIDENCES = ("high", "medium", "low")
FIX_STATUSES = ("pending", "accepted", "rejected", "applied", "rolled_back")
SESSION_STATES = ("idle", "scanning", "analyzing", "interactive", "patching", "done", "failed")
TAINT_RISKS = ("critical", "high", "medium", "low")
EXPLOITABILITY = ("TRIVIAL", "LIKELY", "POSSIBLE", "UNLIKELY")

# ---------------------------------------------------------------------------------------------
# Report kind -> (defect type, severity), per tool.
# ---------------------------------------------------------------------------------------------
MEMCHECK_KINDS = {
    "Leak_DefinitelyLost": ("memory_leak", "high"),
    "Leak_IndirectlyLost": ("memory_leak", "medium"),
    "Leak_PossiblyLost": ("memory_leak", "low"),
    "Leak_StillReachable": ("memory_leak", "info"),
    "InvalidRead": ("buffer_overflow", "critical"),
    "InvalidWrite": ("buffer_overflow", "critical"),
    "InvalidFree": ("invalid_free", "critical"),
    "MismatchedFree": ("invalid_free", "high"),
    "UninitCondition": ("uninit_read", "medium"),
    "UninitValue": ("uninit_read", "medium"),
    "SyscallParam": ("uninit_read", "medium"),
    "Overlap": ("buffer_overflow", "high"),
    "InvalidJump": ("null_deref", "critical"),
    "FishyValue": ("unknown", "low"),
    "ClientCheck": ("unknown", "low"),
}
HELGRIND_KINDS = {
    "Race": ("race_condition", "critical"),
    "UnlockUnlocked": ("race_condition", "high"),
    "UnlockForeign": ("race_condition", "high"),
    "UnlockBogus": ("race_condition", "high"),
    "PthAPIerror": ("race_condition", "medium"),
    "LockOrder": ("race_condition", "high"),
    "Misc": ("race_condition", "medium"),
}
#: ordered, the first pattern found in the block decides
SANITIZER_PATTERNS = (
    ("heap-buffer-overflow", "buffer_overflow", "critical"),
    ("stack-buffer-overflow", "stack_overflow", "critical"),
    ("heap-use-after-free", "use_after_free", "critical"),
    ("double-free", "double_free", "critical"),
    ("null-dereference", "null_deref", "critical"),
    ("detected memory leaks", "memory_leak", "high"),
    ("stack-overflow", "stack_overflow", "critical"),
    ("global-buffer-overflow", "buffer_overflow", "critical"),
)
CPPCHECK_KINDS = {
    "memleak": "memory_leak",
    "resourceLeak": "memory_leak",
    "doubleFree": "double_free",
    "nullPointer": "null_deref",
    "bufferAccessOutOfBounds": "buffer_overflow",
    "useAfterFree": "use_after_free",
    "uninitvar": "uninit_read",
}
CPPCHECK_SEVERITIES = {"error": "high", "warning": "medium", "style": "low"}
INFER_KINDS = {
    "NULL_DEREFERENCE": ("null_deref", "critical"),
    "NULLPTR_DEREFERENCE": ("null_deref", "critical"),
    "MEMORY_LEAK": ("memory_leak", "high"),
    "MEMORY_LEAK_C": ("memory_leak", "high"),
    "RESOURCE_LEAK_C": ("memory_leak", "high"),
    "RESOURCE_LEAK": ("memory_leak", "high"),
    "BUFFER_OVERRUN_L1": ("buffer_overflow", "critical"),
    "BUFFER_OVERRUN_L2": ("buffer_overflow", "high"),
    "BUFFER_OVERRUN_L3": ("buffer_overflow", "medium"),
    "BUFFER_OVERRUN_L4": ("buffer_overflow", "low"),
    "BUFFER_OVERRUN_L5": ("buffer_overflow", "low"),
    "BUFFER_OVERRUN_S2": ("buffer_overflow", "high"),
    "USE_AFTER_FREE": ("use_after_free", "critical"),
    "USE_AFTER_DELETE": ("use_after_free", "critical"),
    "USE_AFTER_LIFETIME": ("use_after_free", "high"),
    "DOUBLE_FREE": ("double_free", "critical"),
    "UNINITIALIZED_VALUE": ("uninit_read", "medium"),
    "DEAD_STORE": ("unknown", "low"),
    "THREAD_SAFETY_violation": ("race_condition", "high"),
    "LOCK_CONSISTENCY_VIOLATION": ("race_condition", "high"),
    "DIVIDE_BY_ZERO": ("unknown", "high"),
    "INTEGER_OVERFLOW_L1": ("unknown", "medium"),
    "STACK_VARIABLE_ADDRESS_ESCAPE": ("dangling_pointer", "high"),
}
INFER_NOISE = ("DEAD_STORE", "CONDITION_ALWAYS_TRUE", "CONDITION_ALWAYS_FALSE")

# ---------------------------------------------------------------------------------------------
# Names of libc files, allocators, and frames that are not user code.
# ---------------------------------------------------------------------------------------------
LIBC_FILES = (
    "strdup.c", "strndup.c", "iofopen.c", "iofdopen.c", "malloc.c", "calloc.c", "realloc.c",
    "mmap.c", "clone.c",
)
CONTEXT_LIBC_FILES = (
    "strdup.c", "strndup.c", "iofopen.c", "iofdopen.c", "malloc.c", "calloc.c", "realloc.c",
)
STACK_ALLOCATORS = (
    "malloc", "calloc", "realloc", "operator new", "operator new[]", "strdup", "strndup",
    "memalign", "aligned_alloc",
)
STACK_DEALLOCATORS = ("free", "operator delete", "operator delete[]", "cfree")
BLOCK_ALLOCATORS = ("malloc", "calloc", "realloc", "strdup", "strndup", "fopen", "operator new")
CHAIN_SKIP = (
    "malloc", "calloc", "realloc", "free", "strdup", "strndup", "operator new",
    "operator delete", "fopen", "fclose", "fopen@@GLIBC_2.2.5", "__fopen_internal", "??", "_end",
    "_start", "__libc_start_main", "start_thread", "clone", "clone3",
)
HEAP_SITE_SKIP = (
    "malloc", "calloc", "realloc", "free", "strdup", "operator new", "operator new[]",
    "operator delete", "__libc_malloc", "__libc_calloc", "_int_malloc", "sysmalloc", "??",
    "__GI__IO_file_doallocate", "__GI__IO_doallocbuf", "__GI__dl_allocate_tls",
    "_IO_new_file_overflow", "_IO_new_file_xsputn", "_IO_new_file_underflow",
    "__GI__IO_default_uflow", "__GI__IO_puts", "__GI__IO_fwrite", "__pthread_create_2_1",
)
HEAP_SYSTEM_PATHS = ("/lib/", "/usr/", "/elf/", "/libio/", "/nptl/")
FLAME_SKIP = (
    "malloc", "calloc", "free", "__libc_malloc", "_int_malloc", "sysmalloc", "[unknown]",
)
NON_USER_PATHS = (
    "/usr/", "/lib/", "/opt/", ".venv/", "/rr/", "/build/", "/node_modules/", "/.cache/",
    "/site-packages/", "/include/", "/sysdeps/", "/csu/", "/elf/",
)
TAINT_SKIP_DIRS = (
    "test", "tests", ".git", "build", ".venv", "vendor", "node_modules", "third_party",
    "external", "deps",
)
ROLE_SKIP_DIRS = (
    ".git", "build", "test", "tests", ".venv", "node_modules", "__pycache__", "vendor",
    "third_party", "external",
)
KNOWN_ALLOCATORS = (
    "malloc", "calloc", "realloc", "aligned_alloc", "strdup", "strndup", "mmap", "g_malloc",
    "g_malloc0", "g_new", "g_new0", "g_strdup", "xmalloc", "xcalloc", "xrealloc", "xstrdup",
    "kmalloc", "kzalloc", "kcalloc", "krealloc", "kvmalloc", "devm_kmalloc", "devm_kzalloc",
)
KNOWN_DEALLOCATORS = ("free", "g_free", "kfree", "kvfree", "devm_kfree", "delete", "delete[]")
EXTENSION_LANGUAGE = {
    "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "py": "python", "rs": "rust",
}
CORPUS_LANGUAGE = {"c": "c", "cpp": "cpp", "py": "python", "rs": "rust"}

# ---------------------------------------------------------------------------------------------
# Size units, binary multiples.
# ---------------------------------------------------------------------------------------------
SIZE_UNITS = {
    "B": 1, "BYTES": 1, "BYTE": 1,
    "KB": 1024, "K": 1024, "KIB": 1024,
    "MB": 1048576, "M": 1048576, "MIB": 1048576,
    "GB": 1073741824, "G": 1073741824, "GIB": 1073741824,
}

# ---------------------------------------------------------------------------------------------
# Weakness ids expected for a defect type; suppression kinds; SARIF levels.
# ---------------------------------------------------------------------------------------------
EXPECTED_CWE = {
    "memory_leak": ["CWE-401"],
    "use_after_free": ["CWE-416"],
    "double_free": ["CWE-415"],
    "buffer_overflow": ["CWE-122", "CWE-787"],
    "null_deref": ["CWE-476"],
    "race_condition": ["CWE-362"],
    "uninit_read": ["CWE-457"],
    "dangling_pointer": ["CWE-825"],
    "invalid_free": ["CWE-761"],
    "stack_overflow": ["CWE-121"],
}
SUPPRESSION_KINDS = {
    "memory_leak": "Leak_DefinitelyLost",
    "use_after_free": "Addr4",
    "double_free": "Free",
    "buffer_overflow": "Addr4",
    "uninit_read": "Cond",
    "null_deref": "Addr4",
}
SARIF_LEVELS = {
    "critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "none",
}

# ---------------------------------------------------------------------------------------------
# Mitigation weights, relevance to defect types, build flags.
# ---------------------------------------------------------------------------------------------
MITIGATION_WEIGHTS = {
    "PIE": 15, "Stack Canary": 15, "NX (No-Execute)": 15, "RELRO": 10, "FORTIFY_SOURCE": 15,
    "Sanitizer": 10, "Debug Info": 5, "ASLR (System)": 15,
}
GRADES = ((95, "A+"), (85, "A"), (70, "B"), (55, "C"), (40, "D"))
MITIGATION_FLAGS = {
    "PIE": "-fPIE -pie",
    "Stack Canary": "-fstack-protector-strong",
    "NX (No-Execute)": "-Wl,-z,noexecstack",
    "RELRO": "-Wl,-z,relro,-z,now",
    "FORTIFY_SOURCE": "-D_FORTIFY_SOURCE=2 -O2",
    "Sanitizer": "-fsanitize=address,undefined",
    "Debug Info": "-g",
    "ASLR (System)": "echo 2 | sudo tee /proc/sys/kernel/randomize_va_space",
}
FLAG_EXEMPT = ("Debug Info", "ASLR (System)")
HEADLINE_MITIGATIONS = ("PIE", "Stack Canary", "NX (No-Execute)")
#: (defect type, mitigation, explanation) in reporting order
MITIGATION_RELEVANCE = (
    ("buffer_overflow", "Stack Canary", "Stack canary detects overflow before return — prevents RIP control"),
    ("buffer_overflow", "PIE", "ASLR via PIE randomizes addresses — attacker can't predict jump targets"),
    ("buffer_overflow", "NX (No-Execute)", "NX prevents executing injected shellcode on stack/heap"),
    ("buffer_overflow", "FORTIFY_SOURCE", "FORTIFY catches dangerous memcpy/strcpy at compile and runtime"),
    ("buffer_overflow", "RELRO", "Full RELRO protects GOT from overwrite via buffer overflow"),
    ("stack_overflow", "Stack Canary", "Canary detects stack smashing before control flow hijack"),
    ("stack_overflow", "NX (No-Execute)", "Even if stack is smashed, injected code can't execute"),
    ("stack_overflow", "PIE", "Return address is randomized — blind ROP is much harder"),
    ("use_after_free", "PIE", "Heap spray is harder when code addresses are randomized"),
    ("use_after_free", "NX (No-Execute)", "Prevents shellcode execution even if heap is controlled"),
    ("use_after_free", "Sanitizer", "ASan catches UAF immediately with shadow memory tracking"),
    ("double_free", "Sanitizer", "ASan detects double-free immediately"),
    ("double_free", "PIE", "Heap metadata corruption harder to exploit with randomized addresses"),
    ("null_deref", "ASLR (System)", "mmap_min_addr prevents mapping NULL page — NULL deref = crash not exploit"),
    ("null_deref", "PIE", "Even if NULL page mapped, code addresses are unknown"),
    ("race_condition", "Sanitizer", "TSan (thread sanitizer) detects races — compile with -fsanitize=thread"),
    ("uninit_read", "Sanitizer", "MSan detects uninitialized reads — compile with -fsanitize=memory"),
    ("uninit_read", "FORTIFY_SOURCE", "Some uninitialized buffer uses caught by fortified libc functions"),
)
#: report text per defect type; {name} parts are filled in only when that mitigation is off
SCENARIOS = {
    "buffer_overflow": (
        "Attacker sends crafted input exceeding buffer size. "
        "Overwrites heap metadata to redirect control flow. {no_canary}{no_nx}{no_pie}"
    ),
    "use_after_free": (
        "Attacker triggers free, then allocates controlled data in the same slot. "
        "When the dangling pointer is dereferenced, attacker-controlled data "
        "is treated as a valid object. {no_pie}{no_nx}"
    ),
    "double_free": (
        "Attacker triggers double-free to corrupt heap metadata. "
        "Crafted subsequent allocation returns attacker-controlled address. "
        "Write-what-where primitive allows arbitrary code execution. {no_pie}"
    ),
    "null_deref": (
        "On older kernels or with mmap_min_addr=0, attacker maps page at NULL "
        "with controlled content. NULL dereference reads attacker data — "
        "can escalate to kernel code execution. {no_aslr}"
    ),
    "race_condition": (
        "Attacker exploits timing window between check and use. "
        "TOCTOU allows bypassing access controls or corrupting shared state. "
        "Exploitation may require repeated attempts but is reliable under load."
    ),
}
SCENARIO_PARTS = {
    "no_canary": ("Stack Canary", "Without stack canary, overflow is undetected. "),
    "no_nx": ("NX (No-Execute)", "Without NX, injected shellcode executes directly. "),
    "no_pie": ("PIE", "Without PIE/ASLR, addresses are predictable. "),
    "no_aslr": ("ASLR (System)", "Without ASLR, NULL page mapping is straightforward. "),
}

# ---------------------------------------------------------------------------------------------
# Input sources (category, function, risk, description, which variable is tainted).
# ---------------------------------------------------------------------------------------------
TAINT_SOURCES = (
    ("network", "recv", "critical", "Network socket read — attacker-controlled data", "buffer_arg"),
    ("network", "recvfrom", "critical", "UDP datagram receive — attacker-controlled", "buffer_arg"),
    ("network", "recvmsg", "critical", "Network message receive (scatter-gather)", "buffer_arg"),
    ("network", "accept", "critical", "Accept incoming connection — attacker-initiated", "return"),
    ("network", "accept4", "critical", "Accept with flags — attacker-initiated", "return"),
    ("network", "SSL_read", "critical", "TLS socket read — decrypted attacker data", "buffer_arg"),
    ("network", "BIO_read", "critical", "OpenSSL BIO read", "buffer_arg"),
    ("network", "read", "high", "File/socket read — context-dependent", "buffer_arg"),
    ("network", "readv", "high", "Scatter read from fd", "buffer_arg"),
    ("network", "pread", "high", "Positional read from fd", "buffer_arg"),
    ("file_io", "fread", "high", "Binary file read — attacker may control file", "buffer_arg"),
    ("file_io", "fscanf", "high", "Formatted file read — no bounds guarantee", "buffer_arg"),
    ("file_io", "getline", "high", "Dynamic-length line read", "return"),
    ("file_io", "getdelim", "high", "Dynamic-length delimited read", "return"),
    ("file_io", "fgetc", "medium", "Single character from file", "return"),
    ("file_io", "fread_unlocked", "high", "Unlocked binary file read", "buffer_arg"),
    ("file_io", "mmap", "high", "Memory-mapped file — attacker may control file", "return"),
    ("stdin", "scanf", "critical", "Formatted stdin read — NO bounds checking", "varargs"),
    ("stdin", "gets", "critical", "Unbounded stdin read — NEVER USE (CWE-242)", "buffer_arg"),
    ("stdin", "getchar", "low", "Single character from stdin", "return"),
    ("stdin", "getc", "low", "Single character from stream", "return"),
    ("stdin", "fgets", "high", "Line-buffered stdin read", "buffer_arg"),
    ("stdin", "gets_s", "medium", "Bounded stdin read (C11)", "buffer_arg"),
    ("argv", "getopt", "high", "Parsed command-line option", "return"),
    ("argv", "getopt_long", "high", "Long option parsing with optarg", "return"),
    ("argv", "getopt_long_only", "high", "Long-only option parsing", "return"),
    ("env_var", "getenv", "high", "Environment variable read — attacker-controlled", "return"),
    ("env_var", "secure_getenv", "medium", "Secure environment read (drops in suid)", "return"),
    ("ipc", "shmat", "critical", "Shared memory attachment — cross-process", "return"),
    ("ipc", "msgrcv", "critical", "System V message queue receive", "buffer_arg"),
    ("ipc", "mq_receive", "critical", "POSIX message queue receive", "buffer_arg"),
    ("ipc", "pipe", "high", "Pipe file descriptors — IPC channel", "buffer_arg"),
)
SAFE_FUNCTIONS = (
    "printf", "fprintf", "sprintf", "snprintf", "puts", "fputs",
    "memset", "bzero", "memcpy", "memmove", "memcmp", "strlen",
    "strcmp", "strncmp", "strchr", "strrchr", "strstr",
    "close", "fclose", "shutdown",
    "pthread_mutex_lock", "pthread_mutex_unlock", "pthread_create", "pthread_join",
    "assert", "abort", "exit", "_exit",
    "log", "syslog", "perror",
    "sizeof", "typeof", "offsetof",
    "if", "for", "while", "switch", "return", "break", "continue",
    "NULL", "true", "false",
)
NON_GLOBALS = ("NULL", "TRUE", "FALSE", "EOF", "STDIN", "STDOUT")

# ---------------------------------------------------------------------------------------------
# Line rules per language (pattern, message, severity).
# ---------------------------------------------------------------------------------------------
C_RULES = (
    (r"\bmalloc\s*\(", "malloc without free check", "low"),
    (r"\bcalloc\s*\(", "calloc without free check", "low"),
    (r"\brealloc\s*\(", "realloc — original ptr lost on failure", "low"),
    (r"\bstrdup\s*\(", "strdup result must be freed", "low"),
    (r"\bnew\b.*\[", "array new — use std::vector", "low"),
    (r"\bfopen\s*\(", "FILE* must be fclose'd", "low"),
)
RUST_RULES = (
    (r"\bunsafe\s*\{", "unsafe block", "medium"),
    (r"\bstd::mem::forget\b", "mem::forget — bypasses Drop", "medium"),
    (r"\bBox::from_raw\b", "Box::from_raw — manual ownership", "medium"),
    (r"\*mut\s+\w+", "raw mutable pointer", "medium"),
    (r"\*const\s+\w+", "raw const pointer", "medium"),
    (r"transmute\b", "transmute — extremely unsafe", "high"),
    (r"ManuallyDrop\b", "ManuallyDrop — must call drop manually", "medium"),
)

# ---------------------------------------------------------------------------------------------
# Advice per language and defect type; "*" is the language's default.
# ---------------------------------------------------------------------------------------------
TIPS = {
    ("c", "memory_leak"): [
        "Replace `malloc`/`free` with `std::unique_ptr<T>` for single ownership",
        "Use `std::make_unique<T>()` (C++14+) — zero overhead, exception-safe",
        "For shared ownership use `std::shared_ptr` with `std::make_shared`",
        "Stack-allocate small objects where possible; heap only when necessary",
    ],
    ("c", "use_after_free"): [
        "Set pointer to `nullptr` immediately after `free()` / `delete`",
        "Use `std::unique_ptr` — it nullifies on destruction automatically",
        "Audit all raw pointer copies; prefer reference-counted ownership",
    ],
    ("c", "double_free"): [
        "Rule of 5: if you define destructor, define copy/move ctor & assignment",
        "Prefer `std::unique_ptr` which prevents double-free by design",
        "Wrap heap resources in RAII classes",
    ],
    ("c", "buffer_overflow"): [
        "Replace C arrays with `std::vector` or `std::array`",
        "Use `std::span` (C++20) for non-owning views with bounds checking",
        "Enable `-D_FORTIFY_SOURCE=2` in release builds",
        "Compile with `-fsanitize=address,undefined` during testing",
    ],
    ("c", "null_deref"): [
        "Check pointer before dereference or use `assert(ptr != nullptr)`",
        "Prefer `std::optional<T>` over nullable pointers for optional values",
        "Use `gsl::not_null<T*>` to enforce non-null at type level",
    ],
    ("c", "*"): [
        "Consider using AddressSanitizer: compile with -fsanitize=address",
        "Run with Valgrind --leak-check=full for exhaustive analysis",
    ],
    ("python", "python_reference_cycle"): [
        "Use `weakref.ref()` or `weakref.WeakValueDictionary` for back-references",
        "Call `gc.collect()` explicitly after deleting large object graphs",
        "Avoid storing `self` in closures/lambdas assigned to instance attrs",
        "Use `objgraph` to visualise reference cycles: `objgraph.show_backrefs(obj)`",
    ],
    ("python", "python_large_object"): [
        "Use generators instead of lists for large sequences",
        "Process data in chunks with `itertools.islice`",
        "Use `numpy` arrays instead of Python lists for numeric data",
        "Profile with `tracemalloc.start(25)` and `snapshot.statistics('lineno')`",
        "Cache with `functools.lru_cache(maxsize=256)` to bound cache size",
    ],
    ("python", "memory_leak"): [
        "Run `import gc; gc.set_debug(gc.DEBUG_LEAK)` to find cycles",
        "Use `memray` for heap profiling: `python -m memray run script.py`",
        "Audit class attributes that accumulate across instances",
        "Use `weakref` for observer/event patterns to avoid retention",
    ],
    ("python", "*"): [
        "Profile with: python -m tracemalloc -n 10 your_script.py",
        "Use memray for flamegraph-based heap profiling",
    ],
    ("rust", "*"): [
        "Run Miri to detect UB in unsafe code: `cargo +nightly miri test`",
        "Consider replacing `unsafe` blocks with safe abstractions",
        "`mem::forget` can be replaced with `ManuallyDrop` for clarity",
        "Use `Pin` for self-referential structures instead of raw pointers",
        "Audit `Box::from_raw` — ensure exactly one `Box::into_raw` pairs with it",
        "Run `cargo clippy -- -W clippy::all -W clippy::pedantic`",
    ],
}

# ---------------------------------------------------------------------------------------------
# Text of the debugging and context reports.
# ---------------------------------------------------------------------------------------------
BREAKPOINT_TEXT = {
    "use_after_free": (
        "USE-AFTER-FREE: Program will hit this breakpoint when the freed "
        "pointer is accessed. Use 'reverse-continue' to go back to the "
        "free() call, then 'reverse-continue' again to find the allocation."
    ),
    "double_free": (
        "DOUBLE-FREE: Break at the second free(). Use 'reverse-continue' "
        "to find the first free(), then 'reverse-continue' to the allocation."
    ),
    "memory_leak": (
        "MEMORY LEAK: {bytes} bytes allocated here but "
        "never freed. Step forward through the function to see where the "
        "pointer is lost (overwritten, goes out of scope, return value ignored)."
    ),
    "buffer_overflow": (
        "BUFFER OVERFLOW: Break at the overflow site. Use 'reverse-stepi' "
        "to watch memory being corrupted byte-by-byte backwards. "
        "Set a watchpoint on the corrupted address to find the exact write."
    ),
    "null_deref": (
        "NULL DEREF: Break at the dereference. Use 'reverse-continue' to "
        "find where the pointer was set to NULL (or never initialized). "
        "Watch the pointer variable to see its full history."
    ),
    "race_condition": (
        "RACE CONDITION: Break at the unsynchronized access. In rr, all "
        "threads are deterministic — use 'info threads' then 'thread N' to "
        "inspect each thread's state. Reverse to see interleaving."
    ),
    "uninit_read": (
        "UNINIT READ: Break at the read. Use 'reverse-continue' to the "
        "variable's declaration. The variable was never assigned between "
        "declaration and use. Check all code paths."
    ),
}
CONTEXT_HEADINGS = {
    "memory_leak": "MEMORY LEAK",
    "use_after_free": "USE-AFTER-FREE (heap-use-after-free)",
    "double_free": "DOUBLE FREE (Invalid free / delete)",
    "buffer_overflow": "BUFFER OVERFLOW (Invalid read/write)",
    "null_deref": "NULL POINTER DEREFERENCE",
    "uninit_read": "UNINITIALISED VALUE USE",
    "invalid_free": "INVALID FREE (mismatched free/delete)",
    "heap_corruption": "HEAP CORRUPTION",
}
#: guidance in branch order: (column, value, text); the first that applies is used
CONTEXT_GUIDANCE = (
    ("bug_type", "memory_leak", (
        "This is a Valgrind Leak_DefinitelyLost/IndirectlyLost error. "
        "Identify EXACTLY which malloc/calloc/realloc/strdup/fopen call is leaking, "
        "trace the ownership path, find where free/fclose SHOULD be called, and "
        "generate a fix that adds the correct deallocation. If it is a linked list "
        "or tree, generate a full free_* traversal function."
    )),
    ("bug_type", "use_after_free", (
        "Identify the free() call and the subsequent use. Explain the dangling pointer. "
        "Fix by either: (a) setting ptr to NULL after free, (b) restructuring to avoid the use, "
        "or (c) using a reference-counted or RAII pattern."
    )),
    ("bug_type", "double_free", (
        "Identify both free() calls. Fix by setting ptr = NULL after first free "
        "and checking for NULL before second free, or restructure ownership."
    )),
    ("bug_type", "buffer_overflow", (
        "Identify the array/buffer size and the access that exceeds it. "
        "Fix by adding bounds checking, using strncpy instead of strcpy, "
        "or using a larger buffer."
    )),
    ("bug_type", "uninit_read", (
        "Identify the variable used without initialization. "
        "Fix by initializing it at declaration or before first use."
    )),
    ("tool", "infer", (
        "This issue was found by Facebook Infer STATIC ANALYSIS — detected "
        "at compile time, not runtime. Infer uses separation logic to prove memory "
        "safety violations exist on reachable code paths. The bug_trace shows the "
        "exact execution path. Fix the issue on the reported path. "
        "Common Infer bugs: NULL_DEREFERENCE (conditional null), RESOURCE_LEAK_C "
        "(file not closed on error path), BUFFER_OVERRUN (off-by-one), "
        "USE_AFTER_FREE, UNINITIALIZED_VALUE."
    )),
    ("bug_type", "race_condition", (
        "This is a Helgrind data race or lock error. Two threads access the same "
        "memory without proper synchronisation. Identify the shared variable, show "
        "both access sites, and fix with: (a) pthread_mutex_lock/unlock around the "
        "critical section, (b) _Atomic qualifier on the variable, or (c) restructuring "
        "to eliminate shared mutable state. Include the full mutex declaration and usage."
    )),
)
EDGE_LABELS = {
    "call": "calls",
    "param": "passes tainted param to",
    "return": "returns tainted value to",
    "global": "taints global read by",
    "struct": "stores in struct read by",
    "direct": "directly in",
}


def lookup(mapping: dict, key: Column) -> Column:
    """A fixed table as a map literal: stays inside codegen, no join."""
    items = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*items), key)


def kind_columns(mapping: dict[str, tuple[str, str]], kind: Column, default: tuple[str, str]):
    """(bug_type, severity) columns of a report kind."""
    bug = F.coalesce(lookup({k: v[0] for k, v in mapping.items()}, kind), F.lit(default[0]))
    sev = F.coalesce(lookup({k: v[1] for k, v in mapping.items()}, kind), F.lit(default[1]))
    return bug, sev


def cve_patterns(spark: SparkSession) -> DataFrame:
    """161 rows: group_id, pos, bug_types, and the columns of the CVE."""
    text = resources.files("defectlake.data").joinpath("cve_patterns.csv").read_text("utf-8")
    body = [line for line in text.splitlines() if not line.startswith("#")]
    rows = [
        (
            int(r["group_id"]), pos, r["bug_types"].split(";"), r["cve_id"], r["name"],
            float(r["similarity"]), r["description"], r["affected_software"],
            r["exploit_likelihood"], float(r["cvss_score"]),
        )
        for pos, r in enumerate(csv.DictReader(body))
    ]
    return spark.createDataFrame(
        rows,
        "group_id INT, pos INT, bug_types ARRAY<STRING>, cve_id STRING, name STRING, "
        "similarity DOUBLE, description STRING, affected_software STRING, "
        "exploit_likelihood STRING, cvss_score DOUBLE",
    )


def taint_sources(spark: SparkSession) -> DataFrame:
    """Input functions: source_type, call_site, risk_level, description, taints."""
    return spark.createDataFrame(
        list(TAINT_SOURCES),
        "source_type STRING, call_site STRING, risk_level STRING, description STRING, taints STRING",
    )


def rule_table(spark: SparkSession, language: str, rules) -> DataFrame:
    """A line-rule pack: language, rule_no, pattern, message, severity."""
    rows = [(language, i, *rule) for i, rule in enumerate(rules)]
    return spark.createDataFrame(
        rows, "language STRING, rule_no INT, pattern STRING, message STRING, severity STRING"
    )


def tips_table(spark: SparkSession) -> DataFrame:
    """Advice: language, bug_type ('*' = default), tips."""
    rows = [(lang, bug, tips) for (lang, bug), tips in TIPS.items()]
    rows += [("cpp", bug, tips) for (lang, bug), tips in TIPS.items() if lang == "c"]
    return spark.createDataFrame(rows, "language STRING, bug_type STRING, tips ARRAY<STRING>")


def mitigation_relevance(spark: SparkSession) -> DataFrame:
    """(bug_type, pos, name, explanation) in reporting order."""
    rows = [(b, i, n, e) for i, (b, n, e) in enumerate(MITIGATION_RELEVANCE)]
    return spark.createDataFrame(rows, "bug_type STRING, pos INT, name STRING, explanation STRING")
