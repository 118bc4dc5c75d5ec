"""Where the driver's tables lie (a module of its own name: two conftest files share theirs)."""

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
