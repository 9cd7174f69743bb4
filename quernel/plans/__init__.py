"""The registered queries; ``registry`` loads all of them."""

from . import registry as registry
