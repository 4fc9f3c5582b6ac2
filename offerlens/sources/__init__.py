from offerlens.sources.tables import *  # noqa: F401,F403
from offerlens.sources.files import *  # noqa: F401,F403
