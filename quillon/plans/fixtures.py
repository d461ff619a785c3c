"""Small inputs written out in full, for queries over formats that the driver's
tables do not hold.  Fixed values."""

REMARKS_YAML = """--- !Analysis
Pass:            prologepilog
Name:            StackSize
Function:        func0
Args:
  - NumStackBytes:   '1'
  - String:          ' stack bytes in function'
...
--- !Analysis
Pass:            asm-printer
Name:            InstructionCount
Function:        func0
Args:
  - NumInstructions: '1'
  - String:          ' instructions in function'
...
"""

REMARKS_YAML_2 = REMARKS_YAML.replace("'1'", "'2'")

#: file, function, rows
REMARK_ROWS = [
    ("path/to/anno.c", "func1", 2),
    ("path/to/anno.c", "func2", 2),
    ("path/to/anno2.c", "func3", 1),
    ("path/to/anno3.c", "func1", 1),
]

INSTR_PROFILE = ":ir\nfoo\n1234\n2\n1\n2\n\nbar\n1234\n2\n30\n40\n\nfoo\n5678\n2\n500\n600\n\nbaz\n5678\n2\n7\n8\n"
OVERFLOW_PROFILE = "overflow\n1\n3\n18446744073709551613\n9223372036854775808\n18446744073709551613\n"

SAMPLE_PROFILE = """_Z3bari:20301:1437
 1: 1437
_Z3fooi:7711:610
 1: 610
main:184019:0
 4: 534
 4.2: 534
 5: 1075
 5.1: 1075
 6: 2080
 7: 534
 9: 2064 _Z3bari:1471 _Z3fooi:631
 10: inline1:1000
  1: 1000
 10: inline2:2000
  1: 2000
_Z3bazi:20301:1000
 1: 1000
"""
SAMPLE_REMAP = [("_Z3bari", "_Z3bazi"), ("inline1", "inline42")]

TRACE_YAML = """records:
  - { type: 0, func-id: 1, cpu: 1, thread: 111, kind: function-enter, tsc: 10001 }
  - { type: 0, func-id: 1, cpu: 1, thread: 111, kind: function-exit, tsc: 10100 }
"""

RANGES = "5\n400540-400540:10\n400650-40066d:31\n400686-400689:3\n4006b0-4006b7:3\n4006b0-4006bf:6\n"

MATRIX = """%%MatrixMarket matrix coordinate real symmetric
%
5 5 7
1 1 5.0
1 3 4.1
2 2 3.0
2 4 2.0
3 3 1.0
4 4 4.0
5 5 5.0
"""
