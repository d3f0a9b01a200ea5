"""Every query by name, with DuckDB SQL for the same rows."""

from lodestar.plans import registry as registry
from lodestar.plans import more as more  # adds to the registry
