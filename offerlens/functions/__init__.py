from offerlens.functions.core import *  # noqa: F401,F403
from offerlens.functions.text import *  # noqa: F401,F403
from offerlens.functions.vectors import *  # noqa: F401,F403
