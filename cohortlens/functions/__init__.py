"""Column -> Column building blocks; all JVM-side built-ins (codegen-friendly)."""
from .text import *  # noqa: F401,F403
from .timex import *  # noqa: F401,F403
from .mathx import *  # noqa: F401,F403
