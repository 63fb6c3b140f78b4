"""What the store raises."""


class StoreError(Exception):
    #: Message templates.
    template = "{0}"

    def __init__(self, *args: object):
        super().__init__(self.template.format(*args))


def _kind(name: str, template: str) -> type[StoreError]:
    return type(name, (StoreError,), {"template": template, "__module__": __name__})


IoError = _kind("IoError", "IO error: {0}")
RecordNotFound = _kind("RecordNotFound", "Record not found: {0}")
BranchNotFound = _kind("BranchNotFound", "Branch not found: {0}")
BlobNotFound = _kind("BlobNotFound", "Blob not found: {0}")
StateNotRegistered = _kind("StateNotRegistered", "State not registered: {0}")
StateExists = _kind("StateExists", "State already exists: {0}")
InvalidSequence = _kind("InvalidSequence", "Invalid sequence: {0} (head is {1})")
BranchExists = _kind("BranchExists", "Branch already exists: {0}")
Serialization = _kind("Serialization", "Serialization error: {0}")
Deserialization = _kind("Deserialization", "Deserialization error: {0}")
Corruption = _kind("Corruption", "Corruption detected: {0}")
StrategyMismatch = _kind("StrategyMismatch", "State strategy mismatch: expected {0}, got {1}")
Locked = _kind("Locked", "Store is locked by another process")
NotInitialized = _kind("NotInitialized", "Store not initialized")
InvalidFormat = _kind("InvalidFormat", "Invalid store format: {0}")
ChecksumMismatch = _kind("ChecksumMismatch", "Checksum mismatch: expected {0}, got {1}")
HashMismatch = _kind("HashMismatch", "Hash mismatch: expected {0}, got {1}")
TransactionError = _kind("TransactionError", "Transaction error: {0}")
InvalidOperation = _kind("InvalidOperation", "Invalid operation: {0}")
SubscriptionDropped = _kind("SubscriptionDropped", "Subscription was dropped")
