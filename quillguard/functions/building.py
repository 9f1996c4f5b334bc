"""Building large expressions quickly."""

from __future__ import annotations

import functools


def quick(f):
    """Makes the columns of f without their call sites, each of which costs several calls of the JVM.

    The expressions here have thousands of nodes, all made in a few lines of this library, which no error message needs.
    """

    @functools.wraps(f)
    def run(*args, **kwargs):
        try:
            from pyspark.errors import utils
        except ImportError:
            return f(*args, **kwargs)
        name = "_enable_debugging_cache"
        if not hasattr(utils, name):
            return f(*args, **kwargs)
        before = getattr(utils, name)
        setattr(utils, name, False)
        try:
            return f(*args, **kwargs)
        finally:
            setattr(utils, name, before)

    return run
