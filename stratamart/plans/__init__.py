"""The named models, by layer. Importing the package registers all of them."""

from stratamart.plans import bronze, demos, examples, gold, silver  # noqa: F401
from stratamart.plans.context import MODELS, MartContext, Model  # noqa: F401
